"""Row filters and identifiers of detections. Plain predicates, which Catalyst pushes as far down as the input allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G


def of_class(df: DataFrame, class_id: int) -> DataFrame:
    return df.where(F.col("class_id") == class_id)


def of_classes(df: DataFrame, class_ids: Sequence[int]) -> DataFrame:
    return df.where(F.col("class_id").isin(list(class_ids)))


def confident(df: DataFrame, above: float) -> DataFrame:
    return df.where(F.col("confidence") > above)


def larger(df: DataFrame, above: float, mask_area: Column | None = None) -> DataFrame:
    """Detections of more area: of the mask where there is one, else of the box."""
    own = G.area(*G.box())
    return df.where((own if mask_area is None else F.coalesce(mask_area, own)) > above)


def every(df: DataFrame, n: int, frame: str = "frame_idx", start: int = 0) -> DataFrame:
    return df.where((F.col(frame) >= start) & (F.col(frame) % n == 0))


def at_frame(df: DataFrame, number: int = 0, frame: str = "frame_idx") -> DataFrame:
    return df.where(F.col(frame) == number)


def supported(points: DataFrame, least: int, key: str = "frame_idx") -> DataFrame:
    """Frames with at least ``least`` points: (key, n)."""
    return points.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def numbered(df: DataFrame, keys: Sequence[str] = ("image_id",), order: str = "det_idx", name: str = "tracker_id") -> DataFrame:
    """Identifiers from 1 in the order of detection."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(order)))


def of_team(df: DataFrame, team_id: int) -> DataFrame:
    return df.where(F.col("team_id") == team_id)


def head(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first n rows in an order: of the table, or of each group."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def until_first(df: DataFrame, found: Column, keys: Sequence[str] = ("video_id",), frame: str = "frame_idx") -> DataFrame:
    """The rows of each group up to and with the first frame where something is found; all of them where nothing is."""
    first = F.min(F.when(found, F.col(frame))).over(W.partitionBy(*keys))
    return df.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(frame) <= F.col("_first"))).drop("_first")


def sampled(df: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    """k rows without replacement, fewer where there are fewer: those of the least hashes of seed and key."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_draw", draw).orderBy("_draw", key).limit(k).drop("_draw")


def require(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def class_named(categories: DataFrame, part: str, default: int = -1) -> DataFrame:
    """One row: the lowest id of a category whose name holds ``part``, in any case, else the default."""
    found = F.when(F.contains(F.lower("name"), F.lit(part.lower())), F.col("id"))
    return categories.agg(F.coalesce(F.min(found), F.lit(default)).alias("id"))


def without(class_ids: Column, *gone: int) -> Column:
    """An array of classes without some of them."""
    return F.array_except(class_ids, F.array(*[F.lit(g) for g in gone]))
