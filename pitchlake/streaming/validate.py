"""Streaming counterpart of the consecutive-value validation: keyed state of four fields."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "last string, streak int, locked string, locked_at int"


def step(state: tuple[str | None, int, str | None, int | None], frames: list[int], values: list[str | None], n: int) -> tuple:
    """The state after the reads; once locked, a value stays. Nulls aren't reads."""
    last, streak, locked, at = state
    for frame, value in zip(frames, values):
        if value is None or value != value:
            continue
        streak = streak + 1 if value == last else 1
        last = value
        if locked is None and streak >= n:
            locked, at = value, frame
    return last, streak, locked, at


def validated_stream(reads: DataFrame, n: int, keys: tuple[str, ...] = ("tracker_id",), idle: str | None = None) -> DataFrame:
    """A row (keys, value, locked_at) when a track's value is locked; reads come in the order of frames.

    Rows of one micro-batch are put in order here; those of a later one must not be earlier. With ``idle`` (reads with
    a watermark on ``event_ts``), the state of a track is dropped when the watermark has passed its last read by that.
    """
    key_fields = ", ".join(f"{k} {reads.schema[k].dataType.simpleString()}" for k in keys)
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def of(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else (None, 0, None, None)
        before = held[2]
        rows = pd.concat(list(batches)).sort_values("frame_idx", kind="stable")
        held = step(tuple(held), [int(f) for f in rows["frame_idx"]], list(rows["value"]), n)
        state.update(held)
        if wait is not None:
            last = int(rows["event_ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        if before is None and held[2] is not None:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "value": [held[2]], "locked_at": [held[3]]})

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.EventTimeTimeout
    return reads.groupBy(*keys).applyInPandasWithState(of, f"{key_fields}, value string, locked_at int", STATE, "append", timeout)


def with_event_time(frames: DataFrame, start: str, fps: float, late: str = "10 seconds") -> DataFrame:
    """``event_ts`` from the frame number, with a watermark: frames later than that are dropped by stateful operators."""
    ts = (F.lit(start).cast("timestamp").cast("double") + F.col("frame_idx") / F.lit(fps)).cast("timestamp")
    return frames.withColumn("event_ts", ts).withWatermark("event_ts", late)


def counts_by_window(detections: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Detections for each class and window of event time."""
    return detections.groupBy(F.window("event_ts", width), "class_id").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "class_id", "n")
