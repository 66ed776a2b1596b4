"""Runs, streaks and cleaning of ordered values; every window is partitioned by the track."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import DEFAULTS, Settings

TRACK = ("tracker_id",)


def streaks(reads: DataFrame, keys: tuple[str, ...] = TRACK, order: tuple[str, ...] = ("frame_idx",), value: str = "value") -> DataFrame:
    """Each read with ``streak``: how many reads of the track in a row, up to it, had its value.

    Only reads count: frames between them don't break a streak, and neither do nulls, which aren't reads.
    """
    reads = reads.where(F.col(value).isNotNull())
    by_track, by_value = W.partitionBy(*keys).orderBy(*order), W.partitionBy(*keys, value).orderBy(*order)
    run = F.row_number().over(by_track) - F.row_number().over(by_value)
    got = reads.withColumn("_run", run)
    return got.withColumn("streak", F.row_number().over(W.partitionBy(*keys, value, "_run").orderBy(*order))).drop("_run")


def validated(reads: DataFrame, n: int, keys: tuple[str, ...] = TRACK, order: tuple[str, ...] = ("frame_idx",), value: str = "value") -> DataFrame:
    """(keys, value, locked_at): the first value read ``n`` times in a row on a track; later streaks don't override it."""
    full = streaks(reads, keys, order, value).where(F.col("streak") == n)
    first = F.min_by(F.struct(F.col(value).alias("value"), F.col(order[0]).alias("at")), F.struct(*order))
    return full.groupBy(*keys).agg(first.alias("_f")).select(*keys, F.col("_f.value").alias(value), F.col("_f.at").alias("locked_at"))


def with_validated(rows: DataFrame, locked: DataFrame, keys: tuple[str, ...] = TRACK, value: str = "value", name: str = "validated", mode: str = "final", frame: str = "frame_idx") -> DataFrame:
    """Rows with the validated value of their track.

    ``final`` gives it to every row of the track, ``online`` only from the frame on that locked it.
    """
    right = locked.select(*keys, F.col(value).alias(name), F.col("locked_at").alias("_locked_at"))
    got = rows.join(right, list(keys), "left")
    if mode == "online":
        got = got.withColumn(name, F.when(F.col("_locked_at") <= F.col(frame), F.col(name)))
    elif mode != "final":
        raise ValueError(f"mode is final or online, not {mode}")
    return got.drop("_locked_at")


def runs(rows: DataFrame, flag: Column | str, keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """(keys, run_id, first, last, length) of each longest run of flagged rows, numbered from 1 in order.

    Rows follow one another by their place in the track, not by the number in ``order``.
    """
    flag = F.col(flag) if isinstance(flag, str) else flag
    by = W.partitionBy(*keys).orderBy(order)
    at = rows.withColumns({"_n": F.row_number().over(by), "_flag": flag}).where("_flag")
    at = at.withColumn("_run", F.col("_n") - F.row_number().over(by))
    got = at.groupBy(*keys, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return got.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("first")).alias("run_id"), "first", "last", "length")


def jumps(path: DataFrame, s: Settings = DEFAULTS, coords: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """The path with ``step``, the distance from the sample before, and ``jump``.

    A step is a jump where it exceeds both ``least_jump`` and the track's median step by ``jump_sigma`` robust
    deviations (1.4826 times the median absolute deviation).
    """
    by, whole = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    if len(coords) == 1:
        step = F.abs(F.col(coords[0]) - F.lag(coords[0]).over(by))
    else:
        step = F.sqrt(sum(((F.col(c) - F.lag(c).over(by)) ** 2 for c in coords), F.lit(0.0)))
    got = path.withColumn("step", step).withColumn("_median", F.median("step").over(whole))
    got = got.withColumn("_mad", F.median(F.abs(F.col("step") - F.col("_median"))).over(whole))
    limit = F.greatest(F.lit(s.least_jump), F.col("_median") + F.lit(s.jump_sigma * 1.4826) * F.col("_mad"))
    return got.withColumn("jump", F.coalesce(F.col("step") > limit, F.lit(False))).drop("_median", "_mad")


def short_runs(path: DataFrame, s: Settings = DEFAULTS, keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """``short``: the sample is in a run of jumps of at most ``longest_jump_run`` samples."""
    by = W.partitionBy(*keys).orderBy(order)
    got = path.withColumn("_run", F.row_number().over(by) - F.sum(F.col("jump").cast("int")).over(by))
    size = F.sum(F.col("jump").cast("int")).over(W.partitionBy(*keys, "_run"))
    return got.withColumn("short", F.col("jump") & (size <= s.longest_jump_run)).drop("_run")


def padded_mask(path: DataFrame, s: Settings = DEFAULTS, keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """``edited``: the sample is within ``run_padding`` samples of a short run."""
    near = W.partitionBy(*keys).orderBy(order).rowsBetween(-s.run_padding, s.run_padding)
    return path.withColumn("edited", F.max("short").over(near))


def interpolated(path: DataFrame, coords: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """Null coordinates filled in a straight line between their neighbours, by place; at the ends by the nearest value."""
    by = W.partitionBy(*keys).orderBy(order)
    got = path.withColumn("_n", F.row_number().over(by))
    # What follows is the last one of the other direction: a frame that grows by a row, not one that is gone through anew for each row.
    before, after = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc("_n"), F.desc("_n")))
    for c in coords:
        at = F.when(F.col(c).isNotNull(), F.col("_n"))
        (v0, n0), (v1, n1) = ((F.last(c, ignorenulls=True).over(w), F.last(at, ignorenulls=True).over(w)) for w in (before, after))
        got = got.withColumns({"_v0": v0, "_n0": n0, "_v1": v1, "_n1": n1})
        line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_n") - F.col("_n0")) / (F.col("_n1") - F.col("_n0"))
        got = got.withColumn(c, F.coalesce(F.col(c), line, F.col("_v0"), F.col("_v1"))).drop("_v0", "_n0", "_v1", "_n1")
    return got.drop("_n")


def smoothing_weights(window: int = 9, degree: int = 2) -> list[list[float]]:
    """Row k: the weights by which a least-squares polynomial over the window gives its k-th value."""
    x = np.vander(np.arange(window) - window // 2, degree + 1)
    return (x @ np.linalg.pinv(x)).tolist()


def smoothed(path: DataFrame, coords: tuple[str, ...] = ("x", "y"), window: int = 9, degree: int = 2, keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """Savitzky-Golay smoothing; the ends take the polynomial of the first and last window, shorter tracks stay as they are."""
    half = window // 2
    by, whole = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    all_rows = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weights = F.array(*[F.array(*[F.lit(v) for v in row]) for row in smoothing_weights(window, degree)])
    got = path.withColumns({"_t": F.row_number().over(by), "_size": F.count("*").over(whole)})
    t, n = F.col("_t"), F.col("_size")
    place = F.when(t <= half, t).when(t > n - half, window - (n - t)).otherwise(F.lit(half + 1)).cast("int")
    for c in coords:
        got = got.withColumns({
            "_head": F.collect_list(F.when(t <= window, F.col(c))).over(all_rows),
            "_tail": F.collect_list(F.when(t > n - window, F.col(c))).over(all_rows),
            "_mid": F.collect_list(c).over(by.rowsBetween(-half, half)),
        })
        taken = F.when(t <= half, F.col("_head")).when(t > n - half, F.col("_tail")).otherwise(F.col("_mid"))
        value = F.aggregate(F.zip_with(taken, F.element_at(weights, place), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        got = got.withColumn(c, F.when(n >= window, value).otherwise(F.col(c))).drop("_head", "_tail", "_mid")
    return got.drop("_t", "_size")


def cleaned(path: DataFrame, s: Settings = DEFAULTS, coords: tuple[str, ...] = ("x", "y"), keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """Jumps removed, gaps interpolated, then smoothed; ``edited`` marks the samples that were replaced."""
    got = padded_mask(short_runs(jumps(path, s, coords, keys, order), s, keys, order), s, keys, order)
    got = got.withColumns({c: F.when(~F.col("edited"), F.col(c)) for c in coords}).drop("step", "jump", "short")
    return smoothed(interpolated(got, coords, keys, order), coords, keys=keys, order=order)


def dense_index(rows: DataFrame, keys: tuple[str, ...] = TRACK, order: str = "frame_idx") -> DataFrame:
    """``t`` from 0 in the order of the frames that are there."""
    return rows.withColumn("t", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def dense(path: DataFrame, coords: tuple[str, ...] = ("x", "y"), time: str = "t", track: str = "tracker_id") -> DataFrame:
    """(time, points): one row for each moment, the coordinates of all tracks in the order of their ids."""
    point = F.struct(F.col(track).alias("k"), F.array(*coords).alias("p"))
    return path.groupBy(time).agg(F.array_sort(F.collect_list(point)).alias("_p")).select(time, F.transform("_p", lambda x: x["p"]).alias("points"))
