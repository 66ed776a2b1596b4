"""Joins, exclusion and suppression of boxes, and the fit of court homographies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..schemas import BOX


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    return left.alias("p"), right.alias("n")


def overlapping() -> Column:
    """That boxes p and n share some area: a cheap test before any ratio."""
    p, n = G.box("p"), G.box("n")
    return (p[0] < n[2]) & (n[0] < p[2]) & (p[1] < n[3]) & (n[1] < p[3])


def pairs(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Every pair of boxes of a frame with both overlaps: (key, a_idx, b_idx, iou, ios), a before b."""
    p, n = _sides(boxes, boxes)
    got = p.join(n, (F.col(f"p.{key}") == F.col(f"n.{key}")) & (F.col("p.det_idx") < F.col("n.det_idx")))
    a, b = G.box("p"), G.box("n")
    return got.select(F.col(f"p.{key}").alias(key), F.col("p.det_idx").alias("a_idx"), F.col("n.det_idx").alias("b_idx"), G.iou(a, b).alias("iou"), G.ios(a, b).alias("ios"))


def match(players: DataFrame, numbers: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",), keep: tuple[str, ...] = (), one_to_one: bool = False, strict: bool = False) -> DataFrame:
    """Numbers on players: pairs of a frame whose intersection over the smaller area is above ``threshold``.

    Gives (keys, p_idx, n_idx, ios, pair_rank) and the columns ``keep`` of the players; ranks go by falling
    overlap, then by both indices. Many-to-many, unless ``one_to_one`` keeps only pairs that are the best of
    both their boxes. Frames are an equality key, so that the join hashes; ``strict`` raises where nothing matches.
    """
    p, n = _sides(players, numbers)
    same = overlapping()
    for k in keys:
        same = same & (F.col(f"p.{k}") == F.col(f"n.{k}"))
    got = p.join(n, same).select(*[F.col(f"p.{k}").alias(k) for k in (*keys, *keep)], F.col("p.det_idx").alias("p_idx"), F.col("n.det_idx").alias("n_idx"), G.ios(G.box("p"), G.box("n")).alias("ios")).where(F.col("ios") > threshold)
    rank = W.partitionBy(*keys).orderBy(F.desc("ios"), "p_idx", "n_idx")
    got = got.withColumn("pair_rank", F.row_number().over(rank))
    if one_to_one:
        first = [F.min("pair_rank").over(W.partitionBy(*keys, c)) for c in ("p_idx", "n_idx")]
        got = got.withColumns({"_p": first[0], "_n": first[1]}).where("pair_rank = _p and pair_rank = _n").drop("_p", "_n")
    if strict and got.isEmpty():
        raise ValueError("no number overlaps a player")
    return got


def outside_all(boxes: DataFrame, zones: DataFrame, key: str = "image_id") -> DataFrame:
    """Boxes whose centre is in no zone of their frame, borders included."""
    p, n = _sides(boxes, zones.select(key, *BOX))
    inside = G.inside(*G.center(*G.box("p")), G.box("n"))
    return p.join(n, (F.col(f"p.{key}") == F.col(f"n.{key}")) & inside, "left_anti")


def center_pairs(boxes: DataFrame, zones: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, n_idx, p_idx): each box n whose centre is inside a zone p."""
    p, n = _sides(zones, boxes)
    inside = G.inside(*G.center(*G.box("n")), G.box("p"))
    return p.join(n, (F.col(f"p.{key}") == F.col(f"n.{key}")) & inside).select(F.col(f"p.{key}").alias(key), F.col("n.det_idx").alias("n_idx"), F.col("p.det_idx").alias("p_idx"))


def suppress(boxes: DataFrame, threshold: float, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Greedy suppression: by falling confidence, a box stays unless its overlap with one that stays is above the threshold.

    Ties in confidence go to the lower det_idx. The fold runs in the JVM over the boxes of one frame, whose
    number is bounded by the detector; frames are spread over the cluster.
    """
    b = F.struct((-F.col("confidence")).alias("minus"), "det_idx", *BOX)
    held = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(b)).alias("_boxes"))
    corners = lambda s: tuple(s[c] for c in BOX)
    kept = F.aggregate(
        "_boxes",
        F.filter("_boxes", lambda _: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda k: G.iou(corners(x), corners(k)) > threshold), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return held.select(*keys, F.inline(kept)).select(*keys, "det_idx", (-F.col("minus")).alias("confidence"), *BOX)


def homographies(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrices that take source points to target points (frames x points x 2), by the normalised direct linear transform."""

    def normal(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = points.mean(1, keepdims=True)
        s = np.sqrt(2) / np.maximum(np.sqrt(((points - mid) ** 2).sum(2)).mean(1), 1e-12)
        t = np.zeros((len(points), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2] = -s[:, None] * mid[:, 0]
        t[:, 2, 2] = 1
        return (points - mid) * s[:, None, None], t

    (a, ta), (b, tb) = normal(source), normal(target)
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y, -u], 2), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y, -v], 2)], axis=1)
    m = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 3) @ ta
    return m / m[:, 2:, 2:]


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    return homographies(source[None], target[None])[0]


def fit_homographies(points: DataFrame, least: int, key: str = "frame_idx") -> DataFrame:
    """(key, matrix) of frames with at least ``least`` correspondences (x, y) to (cx, cy); other frames have no row."""
    fields = points.schema[key].dataType.simpleString()
    held = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kp_idx", "x", "y", "cx", "cy"))).alias("pts")).where(F.size("pts") >= least)
    held = held.select(key, *[F.col("pts")[c].alias(f"{c}_all") for c in ("x", "y", "cx", "cy")])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Frames with equally many points are solved at once.
            for _, same in b.groupby(b["x_all"].map(len)):
                x, y, u, v = (np.stack(same[f"{c}_all"].to_list()) for c in ("x", "y", "cx", "cy"))
                m = homographies(np.stack([x, y], 2), np.stack([u, v], 2))
                yield pd.DataFrame({key: same[key], "matrix": list(m.reshape(-1, 9))})

    return held.mapInPandas(of, f"{key} {fields}, matrix array<double>")


def to_court(positions: DataFrame, matrices: DataFrame, key: str = "frame_idx") -> DataFrame:
    """Positions (x, y) with their court coordinates court_x, court_y; frames without a matrix are dropped."""
    cx, cy = G.projected(F.col("matrix"), F.col("x"), F.col("y"))
    return positions.join(matrices, key).withColumns({"court_x": cx, "court_y": cy}).drop("matrix")
