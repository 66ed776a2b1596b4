"""The sports relations, read from the analytics tables; columns are pruned down to the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.lineage import more_parts
from ..schemas import CLASS_NAMES

COLORS = {0: ("red", "#d62728"), 1: ("blue", "#1f77b4")}
COURT = [(0, 0, 18), (1, 10, 4), (2, 30, 0), (3, 70, 2), (4, 94, 15), (5, 90, 40), (6, 50, 50), (7, 8, 42)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each box: image_id, det_idx from 1, class_id, confidence, x1, y1, x2, y2.

    A large table is spread over more parts than a shuffle has, so that what a task sorts doesn't grow with it.
    """
    # Numbered by the frame's own name, so that what follows knows how the rows are spread and needs no second shuffle; all else is derived after it.
    order = W.partitionBy("image_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    if n := more_parts(rows):
        rows = rows.repartition(*n, "image_id")
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
    return rows.withColumn("det_idx", F.row_number().over(order)).select(
        "image_id",
        "det_idx",
        (F.col("l_suppkey") % 5).cast("int").alias("class_id"),
        (F.col("l_quantity").cast("int") / F.lit(50.0)).alias("confidence"),
        x.cast("double").alias("x1"),
        y.cast("double").alias("y1"),
        (x + 10 + F.col("l_quantity")).cast("double").alias("x2"),
        (y + 20 + F.col("l_linenumber")).cast("double").alias("y2"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    split = F.when(k % 10 < 8, "train").when(k % 10 == 8, "valid").otherwise("test")
    return table(spark, sf_dir, "orders").select(k.alias("id"), split.alias("split"), F.concat(F.lit("img_"), k.cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(1280).alias("width"), F.lit(720).alias("height"))


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    team, number = (F.col("p_partkey") % 2).cast("int"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").groupBy(team.alias("team_id"), number.alias("number")).agg(F.min("p_name").alias("player"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read on tracks: tracker_id, frame_idx from 1, value."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tracker_id"), F.row_number().over(order).alias("frame_idx"), F.col("event_type").alias("value"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions along tracks: tracker_id, frame_idx from 1, x."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tracker_id"), F.row_number().over(order).alias("frame_idx"), F.col("value").alias("x"))


def court_vertices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(x), float(y)) for k, x, y in COURT], "kp_idx int, cx double, cy double")


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court vertices seen through a projective map that shifts from frame to frame."""
    frame, cx, cy = F.col("o_orderkey"), F.col("cx"), F.col("cy")
    w = cx / 1000 + cy / 500 + 1
    seen = table(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(court_vertices(spark)))
    return seen.select(
        frame.alias("frame_idx"), "kp_idx", "cx", "cy",
        ((cx + cy / 10 + frame % 50) / w).alias("x"),
        ((cy * 9 / 10 + 5) / w).alias("y"),
        (((frame + F.col("kp_idx") * 7) % 10).cast("double") / F.lit(10.0)).alias("confidence"),
    )


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, "none") for k, v in CLASS_NAMES.items()], "id int, name string, supercategory string")


def teams(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n, c) for k, (n, c) in COLORS.items()], "team_id int, team string, color string")


def videos(spark: SparkSession, sf_dir: str, frames: int = 500, width: int = 1280, height: int = 720, fps: float = 30.0) -> DataFrame:
    """What a container says of each video: video_id, width, height, fps, frames (one more than the last that is there)."""
    video = F.floor(F.col("o_orderkey") / frames)
    got = table(spark, sf_dir, "orders").groupBy(video.alias("video_id")).agg((F.max(F.col("o_orderkey") % frames) + 1).alias("frames"))
    return got.select("video_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(fps).alias("fps"), "frames")


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
