from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchlake.functions import images as I
from pitchlake.operators import annotations as A
from pitchlake.operators import drawing, sequence
from pitchlake.sources import views as V


def frame():
    return np.arange(6 * 4 * 3, dtype=np.uint8).reshape(4, 6, 3)


def test_crop_and_resize(spark):
    rows = [(bytes(frame().tobytes()), 6, 4, 1.0, 1.0, 4.0, 3.0), (None, 6, 4, 0.0, 0.0, 1.0, 1.0), (bytes(frame().tobytes()), 6, 4, -5.0, -5.0, 99.0, 99.0)]
    df = spark.createDataFrame(rows, "image binary, w int, h int, x1 double, y1 double, x2 double, y2 double")
    c = I.crop(F.col("image"), F.col("w"), F.col("h"), *[F.col(k) for k in ("x1", "y1", "x2", "y2")])
    got = [r["c"] for r in df.select(c.alias("c")).collect()]
    assert (got[0]["width"], got[0]["height"]) == (3, 2) and bytes(got[0]["pixels"]) == frame()[1:3, 1:4].tobytes()
    assert got[1]["pixels"] is None and (got[2]["width"], got[2]["height"]) == (6, 4)
    small = I.resize_array(frame(), 3, 2)
    assert small.shape == (2, 3, 3) and (small[1, 2] == frame()[2, 4]).all()
    assert I.resize_array(frame()[:0], 2, 2).shape == (2, 2, 3)


def test_frames_through_a_callback_and_back(spark, tmp_path):
    df = spark.createDataFrame([(1, k, bytes([k])) for k in range(5)], "video_id int, frame_idx int, image binary")
    I.write_frames(I.map_frames(df, lambda image, k: image * (k + 1)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).orderBy("frame_idx").collect()
    assert [len(r["image"]) for r in back] == [1, 2, 3, 4, 5]


def test_profiles(spark):
    rows = [(1, 1, 4, 0.35, 0.0, 0.0, 4.0, 4.0), (1, 2, 4, 0.9, 0.0, 0.0, 4.0, 4.0), (1, 3, 2, 0.1, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "image_id bigint, det_idx int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert A.build(df, 5, "basic").count() == 3 and A.build(df, 5).count() == 2
    with pytest.raises(ValueError):
        A.build(df, 5, "other")


def test_labels_join_and_commands(spark):
    images = spark.createDataFrame([(0, "train", "a.jpg"), (1, "valid", "a.jpg")], "id bigint, split string, file_name string")
    labels = spark.createDataFrame([("train", "a", 2)], "split string, stem string, class_id int")
    assert {r["id"]: r["class_id"] for r in A.with_labels(images, labels).collect()} == {0: 2, 1: None}
    assert drawing.vertex_commands(V.court_vertices(spark).selectExpr("kp_idx as frame_idx", "cx as x", "cy as y"), "red").count() == 8
    masks = spark.createDataFrame([(1, 1, 3, [(0, 5)])], "image_id int, det_idx int, tracker_id int, mask array<struct<start:int,len:int>>")
    assert drawing.mask_commands(masks, ["a", "b"]).first()["color"] == "b"


def test_dense(spark):
    df = spark.createDataFrame([(0, 2, 5.0, 6.0), (0, 1, 3.0, 4.0)], "t int, tracker_id int, x double, y double")
    assert sequence.dense(df).first()["points"] == [[3.0, 4.0], [5.0, 6.0]]
