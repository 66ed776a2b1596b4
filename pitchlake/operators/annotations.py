"""Annotation datasets: ids, merging of truth and predictions, lookups and documents to export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..schemas import BOX, DEFAULTS, Settings
from . import filters, spatial
from .lineage import more_parts, written

SPLITS = ("train", "valid", "test")


def split_order(split: Column | str) -> Column:
    split = F.col(split) if isinstance(split, str) else split
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), split)


def with_ids(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Numbers from 0 over the whole table in the given order, without bringing it into one task.

    The rows are range-partitioned, into more parts than a shuffle has where their bytes ask for it, and sorted within each
    part, so that their place in it numbers them without another shuffle; the counts of the parts (one row each) give the
    offsets. The parts are written to the checkpoint folder first, so that both reads of them, and a task that runs again,
    see the same ones.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_o{k}" for k in range(len(cols))]
    parts = df.withColumns(dict(zip(names, cols)))
    parts = parts.repartitionByRange(*more_parts(df), *names).sortWithinPartitions(*names)
    parts = written(parts.withColumn("_at", F.monotonically_increasing_id()))  # the part in the upper 31 bits, the place in the lower 33
    parts = parts.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_before", "_at", *names)


def predictions(boxes: DataFrame, s: Settings = DEFAULTS, jersey_class: int = 4, scoreboard_class: int = 0, referee_class: int = 3) -> DataFrame:
    """Jersey boxes: confident ones, after suppression, whose centre is in no scoreboard and on no referee.

    The order matters: a box that is dropped for its place has suppressed others before.
    """
    jersey = filters.confident(filters.of_class(boxes, jersey_class), s.jersey_confidence)
    board = filters.confident(filters.of_class(boxes, scoreboard_class), s.scoreboard_confidence)
    kept = spatial.suppress(jersey, s.suppression_overlap)
    zones = board.select("image_id", *BOX).unionByName(filters.of_class(boxes, referee_class).select("image_id", *BOX))
    return spatial.outside_all(kept, zones)


def build(boxes: DataFrame, new_category: int, profile: str = "filtered", s: Settings = DEFAULTS, jersey_class: int = 4) -> DataFrame:
    """The merged dataset with its ids. ``basic`` takes every prediction above ``basic_confidence``, ``filtered`` those of ``predictions``."""
    if profile == "filtered":
        predicted = predictions(boxes, s, jersey_class).withColumn("category_id", F.lit(new_category))
        got = merged(boxes.where(F.col("class_id") != jersey_class), predicted)
    elif profile == "basic":
        got = merged_at_once(boxes, new_category, s.basic_confidence, jersey_class)
    else:
        raise ValueError(f"profile is basic or filtered, not {profile}")
    return with_ids(got, ["image_id", "origin", "seq"], "id")


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Every image with the rows of its label file, by split and name without its ending; images without one stay."""
    return images.withColumn("stem", X.stem(F.col("file_name"))).join(labels, ["split", "stem"], "left")


def merged(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth and predictions as annotations: (image_id, origin, seq, category_id, x, y, w, h, area, score).

    ``origin`` is 0 for truth, 1 for predictions; ``seq`` counts within image and origin, predictions by falling score.
    """
    x, y, w, h = G.xyxy_to_xywh(*G.box())
    shape = [x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area")]
    by = W.partitionBy("image_id")
    a = truth.select("image_id", F.lit(0).alias("origin"), F.row_number().over(by.orderBy("det_idx")).alias("seq"), F.col("class_id").alias("category_id"), *shape)
    b = predicted.select("image_id", F.lit(1).alias("origin"), F.row_number().over(by.orderBy(F.desc("confidence"), "det_idx")).alias("seq"), F.col("category_id"), *shape, F.col("confidence").alias("score"))
    return a.unionByName(b, allowMissingColumns=True)


def merged_at_once(boxes: DataFrame, new_category: int, above: float, jersey_class: int) -> DataFrame:
    """``merged`` of all other boxes and of the jersey boxes above a confidence, which are rows of one table: one scan and one window."""
    jersey = F.col("class_id") == jersey_class
    rows = boxes.where(F.when(jersey, F.col("confidence") > above).otherwise(F.col("class_id") != jersey_class))
    rows = rows.withColumns({"origin": jersey.cast("int"), "score": F.when(jersey, F.col("confidence"))})
    seq = F.row_number().over(W.partitionBy("image_id", "origin").orderBy(F.desc("score"), "det_idx"))
    x, y, w, h = G.xyxy_to_xywh(*G.box())
    category = F.when(jersey, F.lit(new_category)).otherwise(F.col("class_id"))
    return rows.select("image_id", "origin", seq.alias("seq"), category.alias("category_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), "score")


def with_new_category(categories: DataFrame, name: str) -> DataFrame:
    """The categories and one more, whose id is how many there were."""
    new = categories.agg(F.count("*").cast("int").alias("id")).select("id", F.lit(name).alias("name"), F.lit("none").alias("supercategory"))
    return categories.unionByName(new)


def named(annotations: DataFrame, categories: DataFrame, unknown: str = "unknown", strict: bool = False) -> DataFrame:
    """Annotations with ``name`` of their category; ``strict`` raises where one has none."""
    names = categories.select(F.col("id").alias("category_id"), "name")
    if strict and not annotations.join(names, "category_id", "left_anti").isEmpty():
        raise KeyError("an annotation's category isn't listed")
    return annotations.join(names, "category_id", "left").withColumn("name", F.coalesce("name", F.lit(unknown)))


def last_by_name(images: DataFrame) -> DataFrame:
    """One image for each file name, the one of the highest id."""
    return images.groupBy("file_name").agg(F.max_by(F.struct("id", "split", "width", "height"), "id").alias("_i")).select("file_name", "_i.*")


def first_split(images: DataFrame) -> DataFrame:
    """The first of the splits, in their order, that holds each file name."""
    return images.groupBy("file_name").agg(F.min_by("split", split_order("split")).alias("split"))


def grouped(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image with the array of its annotations, by id; empty where it has none."""
    own = [c for c in annotations.columns if c != "image_id"]
    held = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("annotations"))
    got = images.join(held, images["id"] == held["image_id"], "left").drop("image_id")
    return got.withColumn("annotations", F.coalesce("annotations", F.array().cast(held.schema["annotations"].dataType)))


def parsed_yolo(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): label lines of at least five fields as numbers, and the lines that aren't."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    got = lines.withColumn("_p", parts)
    number = lambda k: F.try_element_at("_p", F.lit(k)).try_cast("double")
    got = got.withColumns({"class_id": F.try_element_at("_p", F.lit(1)).try_cast("int"), "xc": number(2), "yc": number(3), "w": number(4), "h": number(5)})
    good = (F.size("_p") >= 5) & F.col("class_id").isNotNull() & F.col("xc").isNotNull() & F.col("yc").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    return got.where(good).drop("_p"), got.where(~good).select(*lines.columns)


def voc_object(name: Column, x: Column, y: Column, w: Column, h: Column, escape: bool = True) -> Column:
    """The lines of one object of a Pascal VOC file."""
    safe = X.xml_escaped(name) if escape else name
    tag = lambda t, v: F.concat(F.lit(f"            <{t}>"), v.cast("int").cast("string"), F.lit(f"</{t}>"))
    return F.concat_ws("\n", F.lit("    <object>"), F.concat(F.lit("        <name>"), safe, F.lit("</name>")), F.lit("        <bndbox>"), tag("xmin", x), tag("ymin", y), tag("xmax", x + w), tag("ymax", y + h), F.lit("        </bndbox>"), F.lit("    </object>"))


def voc_documents(images: DataFrame, annotations: DataFrame, escape: bool = True) -> DataFrame:
    """(id, file_name, xml): a Pascal VOC document for every image, objects by annotation id.

    ``annotations``: image_id, id, name, x, y, w, h.
    """
    one = F.struct("id", voc_object(F.col("name"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), escape).alias("xml"))
    held = annotations.groupBy(F.col("image_id")).agg(F.array_sort(F.collect_list(one)).alias("_o")).select("image_id", F.array_join(F.transform("_o", lambda o: o["xml"]), "\n").alias("_objects"))
    got = images.join(held, images["id"] == held["image_id"], "left")
    size = lambda t, v: F.concat(F.lit(f"        <{t}>"), v.cast("string"), F.lit(f"</{t}>"))
    name = X.xml_escaped(F.col("file_name")) if escape else F.col("file_name")
    xml = F.concat_ws("\n", F.lit("<annotation>"), F.concat(F.lit("    <filename>"), name, F.lit("</filename>")), F.lit("    <size>"), size("width", F.col("width")), size("height", F.col("height")), size("depth", F.lit(3)), F.lit("    </size>"), F.col("_objects"), F.lit("</annotation>"))
    return got.select("id", "file_name", xml.alias("xml"))
