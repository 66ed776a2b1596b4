from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import models
from pitchlake.functions import text as X
from pitchlake.operators import annotations as A
from pitchlake.operators import drawing, lineage, teams
from pitchlake.sources import files
from pitchlake.sources import views as V


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    """A small labelled dataset; there is no test split."""
    root = tmp_path_factory.mktemp("data")
    for split in ("train", "valid"):
        (root / split / "images").mkdir(parents=True)
        (root / split / "labels").mkdir()
    # A 1 x 1 bitmap is an image that Spark's reader decodes, whatever its name.
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + b"\x10\x20\x30\x00"
    for split, name in (("train", "b"), ("train", "a"), ("valid", "a")):
        (root / split / "images" / f"{name}.jpg").write_bytes(bmp)
    (root / "train" / "labels" / "a.txt").write_text("2 0.5 0.5 0.5 0.5\n\n4 0.1 0.1\n  3 0.25 0.25 0.5 0.5 \n")
    (root / "data.yaml").write_text("names:\n  0: ball\n  1: player\n")
    return str(root)


def test_dataset_scan(spark, dataset):
    got = files.dataset_images(spark, dataset).orderBy("id").collect()
    assert [(r["id"], r["split"], r["file_name"], r["width"], r["height"]) for r in got] == [(0, "train", "a.jpg", 1, 1), (1, "train", "b.jpg", 1, 1), (2, "valid", "a.jpg", 1, 1)]
    assert files.present_splits(dataset) == ["train", "valid"]


def test_labels_and_rejected_lines(spark, dataset):
    good, bad = files.yolo_labels(spark, dataset)
    assert sorted((r["stem"], r["class_id"], r["xc"]) for r in good.collect()) == [("a", 2, 0.5), ("a", 3, 0.25)]
    assert sorted(r["value"] for r in bad.collect()) == ["", "4 0.1 0.1"]


def test_class_names_and_listing(spark, dataset, tmp_path):
    assert [r["name"] for r in files.class_names(spark, f"{dataset}/data.yaml").orderBy("id").collect()] == ["ball", "player"]
    (tmp_path / "l.yaml").write_text("names: [x, y]")
    assert files.class_names(spark, str(tmp_path / "l.yaml")).count() == 2
    (tmp_path / "v.mp4").write_bytes(b"1")
    (tmp_path / "v.txt").write_bytes(b"1")
    assert files.listed(spark, str(tmp_path)).count() == 1


def test_coco_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(0, "a.jpg", 4, 3, None, None)], "id bigint, file_name string, width int, height int, license int, date_captured string")
    rows = [(1, 0, 4, [1.0, 2.0, 3.0, 4.0], 12.0, [], 0, 0.5), (0, 0, 2, [0.0, 0.0, 1.0, 1.0], 1.0, [], 0, None)]
    annotations = spark.createDataFrame(rows, "id bigint, image_id bigint, category_id int, bbox array<double>, area double, segmentation array<array<double>>, iscrowd int, score double")
    doc = files.coco_document(images, annotations, V.categories(spark), {"description": "d"})
    raw = json.loads(doc.first()["json"])
    assert raw["images"][0]["license"] is None and "score" not in raw["annotations"][0] and raw["annotations"][1]["score"] == 0.5
    files.write_coco(doc, str(tmp_path / "coco"))
    back = files.read_coco(spark, str(tmp_path / "coco"))
    assert {r["id"]: r["score"] for r in back["annotations"].collect()} == {0: None, 1: 0.5}
    assert back["categories"].count() == 5
    files.write_coco_lines(images, annotations, V.categories(spark), str(tmp_path / "lines"))
    lines = files.read_coco_lines(spark, str(tmp_path / "lines"))
    assert {r["id"]: r["score"] for r in lines["annotations"].collect()} == {0: None, 1: 0.5}
    assert "license" in "".join(p.read_text() for p in (tmp_path / "lines" / "images").glob("*.json"))


def test_coco_of_more_than_one_document_loses_nothing(spark, tmp_path):
    images = spark.range(60).select("id", F.concat(F.lit("ü"), F.col("id")).alias("file_name"), F.lit(4).alias("width"), F.lit(3).alias("height"), F.lit(None).cast("int").alias("license"), F.lit(None).cast("string").alias("date_captured"))
    # ids against the order of images, image 7 has most, 70 isn't listed
    image = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, 70).otherwise(59 - F.col("id") % 60)
    annotations = spark.range(300).select("id", image.cast("long").alias("image_id"), F.lit(2).alias("category_id"), F.array(F.lit(1.0)).alias("bbox"), F.lit(1.0).alias("area"), F.array().cast("array<array<double>>").alias("segmentation"), F.lit(0).alias("iscrowd"), F.lit(None).cast("double").alias("score"))
    (one,) = files.coco_document(images, annotations, V.categories(spark), {"description": "d"}).collect()
    whole, docs = json.loads(one["json"]), files.coco_document(images, annotations, V.categories(spark), {"description": "d"}, most=4000)
    several = [json.loads(r["json"]) for r in docs.collect()]
    assert 5 < len(several) < 20 and all(d["categories"] == whole["categories"] and d["info"] == whole["info"] for d in several)
    for section in ("images", "annotations"):
        assert [x["id"] for x in whole[section]] == list(range(len(whole[section])))
        assert all([x["id"] for x in d[section]] == sorted(x["id"] for x in d[section]) for d in several)
        assert sorted((x for d in several for x in d[section]), key=lambda x: x["id"]) == whole[section]
    place = {x["id"]: k for k, d in enumerate(several) for x in d["images"]}
    assert all(place.get(x["image_id"], k) == k for k, d in enumerate(several) for x in d["annotations"])
    files.write_coco(docs, str(tmp_path / "coco"))
    assert files.read_coco(spark, str(tmp_path / "coco"))["annotations"].count() == 300
    (empty,) = files.coco_document(images.limit(0), annotations.limit(0), V.categories(spark), {}).collect()
    assert json.loads(empty["json"])["images"] == json.loads(empty["json"])["annotations"] == []


def test_voc_escapes_and_keeps_empty_images(spark, tmp_path):
    images = spark.createDataFrame([(0, "a.jpg", 4, 3), (1, "b.jpg", 4, 3)], "id bigint, file_name string, width int, height int")
    items = spark.createDataFrame([(0, 0, "a<b", 1.0, 2.0, 3.0, 4.0)], "image_id bigint, id bigint, name string, x double, y double, w double, h double")
    docs = A.voc_documents(images, items)
    got = {r["file_name"]: r["xml"] for r in docs.collect()}
    assert "a&lt;b" in got["a.jpg"] and "<ymax>6</ymax>" in got["a.jpg"] and "<object>" not in got["b.jpg"]
    assert "a<b" in A.voc_documents(images, items, escape=False).where("id = 0").first()["xml"]
    files.write_voc(docs, str(tmp_path / "voc"))
    assert sorted(p.name for p in (tmp_path / "voc").iterdir()) == ["a.xml", "b.xml"]


def test_upload_retries_and_reports(spark):
    def client():
        seen = {}

        def send(name, split, xml):
            seen[name] = seen.get(name, 0) + 1
            if name == "bad" or name == "flaky" and seen[name] < 3:
                raise OSError("no")

        return send

    docs = spark.createDataFrame([("ok", "t", "x"), ("flaky", "t", "x"), ("bad", "t", "x")], "file_name string, split string, xml string")
    assert {r["file_name"]: r["error"] for r in files.upload(docs, client).collect()} == {"ok": None, "flaky": None, "bad": "no"}


def test_lookups(spark):
    images = spark.createDataFrame([(1, "valid", "a", 1, 1), (2, "train", "a", 1, 1), (3, "test", "b", 1, 1)], "id bigint, split string, file_name string, width int, height int")
    assert {(r["file_name"], r["id"]) for r in A.last_by_name(images).collect()} == {("a", 2), ("b", 3)}
    assert {(r["file_name"], r["split"]) for r in A.first_split(images).collect()} == {("a", "train"), ("b", "test")}
    a = spark.createDataFrame([(1, 9)], "image_id bigint, category_id int")
    assert A.named(a, V.categories(spark)).first()["name"] == "unknown"
    with pytest.raises(KeyError):
        A.named(a, V.categories(spark), strict=True)
    assert {r["id"]: len(r["annotations"]) for r in A.grouped(images, a).collect()} == {1: 1, 2: 0, 3: 0}
    assert A.with_ids(images.limit(0), ["id"], "n").isEmpty()


def test_numbering_sorts_once_in_parts_of_bounded_size(spark, monkeypatch):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("v"))
    for size, most in ((lineage.PART_BYTES, 5000), (2000, 500)):
        monkeypatch.setattr(lineage, "PART_BYTES", size)
        got = A.with_ids(df, [-F.col("v"), "k"], "n")
        assert [r["n"] for r in got.orderBy(F.desc("v"), "k").collect()] == list(range(5000))
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) <= most


def test_basic_merge_is_one_scan_and_equals_the_union(spark):
    rows = [(1, 1, 4, 0.35), (1, 2, 4, 0.9), (1, 3, 2, 0.1), (1, 4, None, 0.9), (1, 5, 4, 0.3), (1, 6, 4, None), (1, 7, 0, None), (1, 8, 4, 0.9), (2, 1, 4, float("nan")), (2, 2, 4, 0.5)]
    df = spark.createDataFrame([(*r, 0.0, 1.0, 4.0, 4.0) for r in rows], "image_id bigint, det_idx int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    want = A.merged(df.where("class_id <> 4"), df.where("class_id = 4 and confidence > 0.3").withColumn("category_id", F.lit(9)))
    got = A.merged_at_once(df, 9, 0.3, 4)
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    plan = A.merged_at_once(V.detections(spark, "/root/testdata/sf0.001"), 9, 0.3, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange") == 1


def test_labels(spark):
    df = spark.createDataFrame([("7", "Ann"), (None, None)], "n string, p string")
    assert [r[0] for r in df.select(X.player_label(F.col("n"), F.col("p"))).collect()] == ["#7 Ann", "#None None"]
    assert df.select(X.player_label(F.col("n"), F.col("p"), None)).collect()[1][0] is None
    assert df.select(X.score_label(F.lit("ball"), F.lit(0.517))).first()[0] == "ball 0.52"


def test_team_clusters_separate(spark):
    rows = [(k, [float(k % 2) * 5 + 0.01 * k] * 8) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["team_id"] for r in teams.classify(teams.fit_teams(df), df).collect()}
    assert len({got[k] for k in range(0, 40, 2)}) == len({got[k] for k in range(1, 40, 2)}) == 1 and got[0] != got[1]
    crops = spark.createDataFrame([(1, 1, 0, 0), (1, 1, 5, 1)], "video_id int, tracker_id int, frame_idx int, team_id int")
    assert teams.lock_teams(crops).first()["team_id"] == 0


def test_models_plug_in(spark):
    models.register_model("double", lambda: lambda xs: [str(2 * x) for x in xs])
    assert sorted(r["y"] for r in models.apply_model(spark.range(3), "double", "id", "y").collect()) == ["0", "2", "4"]
    df = spark.createDataFrame([(1, b"ab")], "image_id bigint, image binary")
    answer = lambda state, prompt: [{"confidence": 0.5, "x1": 0.0, "y1": 0.0, "x2": float(state), "y2": 1.0}] * (2 if prompt == "jersey number" else 1)
    got = models.prompted(df, len, answer, ["scoreboard", "jersey number"])
    assert got.count() == 3 and {r["x2"] for r in got.collect()} == {2.0}
    boxes = spark.createDataFrame([(1, [(4, 0.5, 0.0, 0.0, 1.0, 1.0)])], f"image_id bigint, boxes {models.BOXES}")
    assert models.exploded(boxes, ("image_id",)).first()["det_idx"] == 1


def test_frames_source_skips_segments(spark):
    spark.dataSource.register(files.Frames)
    frames = spark.read.format("frames").option("frames", "300,120").option("segment", 100)
    assert frames.load().count() == 420
    assert frames.option("stride", 30).load().count() == 14
    only = frames.option("stride", 1).load().where("frame_idx = 0")
    assert sorted(r["video_id"] for r in only.collect()) == [0, 1] and only.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("where,want", [("frame_idx = 3 and frame_idx = 3", 2), ("frame_idx = 3 and frame_idx = 5", 0), ("frame_idx = cast(null as int)", 0), ("frame_idx = 3 and frame_idx > 3", 0), ("frame_idx = 3 or frame_idx = 5", 4)])
def test_frame_filters_are_all_applied(spark, where, want):
    spark.dataSource.register(files.Frames)
    assert spark.read.format("frames").option("frames", "300,120").load().where(where).count() == want


def test_palette_and_paths(spark):
    df = spark.createDataFrame([(-1,), (0,), (3,)], "k int").select(drawing.palette_color(F.col("k"), ["a", "b", "c"]))
    assert [r[0] for r in df.collect()] == ["c", "a", "a"]
    runs = spark.createDataFrame(pd.DataFrame({"tracker_id": [1], "run_id": [1], "first": [2], "last": [3]}))
    assert drawing.path_commands(runs, "red").first()["color"] == "red"
