from __future__ import annotations

import random
import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitchlake.operators import sequence as S
from pitchlake.schemas import DEFAULTS
from pitchlake.streaming import identity as loop
from pitchlake.streaming import tracker, validate


def reads(spark, values, track=1):
    return spark.createDataFrame([(track, k + 1, v) for k, v in enumerate(values)], "tracker_id bigint, frame_idx int, value string")


def path(spark, xs):
    return spark.createDataFrame([(1, k + 1, None if x is None else float(x), 0.0) for k, x in enumerate(xs)], "tracker_id bigint, frame_idx int, x double, y double")


def values(df, column="x"):
    return [r[column] for r in df.orderBy("frame_idx").collect()]


def test_first_streak_locks_for_good(spark):
    got = S.validated(reads(spark, "aabaaaccc"), 3).collect()
    assert [(r["value"], r["locked_at"]) for r in got] == [("a", 6)]
    assert S.validated(reads(spark, "abab"), 3).isEmpty()


def test_online_mode_waits_for_the_lock(spark):
    r = reads(spark, "aaab")
    locked = S.validated(r, 3)
    assert values(S.with_validated(r, locked, mode="online"), "validated") == [None, None, "a", "a"]
    assert values(S.with_validated(r, locked), "validated") == ["a"] * 4
    with pytest.raises(ValueError):
        S.with_validated(r, locked, mode="other")


def test_streaks_equal_a_state_machine(spark):
    r = random.Random(3)
    rows = [(t, k, r.choice("ab")) for t in range(20) for k in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "tracker_id bigint, frame_idx int, value string")
    want = {}
    for t in range(20):
        mine = [(k, v) for i, k, v in rows if i == t]
        _, _, locked, at = validate.step((None, 0, None, None), [k for k, _ in mine], [v for _, v in mine], 3)
        if locked is not None:
            want[t] = (locked, at)
    assert {g["tracker_id"]: (g["value"], g["locked_at"]) for g in S.validated(df, 3).collect()} == want


def test_runs(spark):
    df = spark.createDataFrame([(1, k, c == "1") for k, c in enumerate("01100111")], "tracker_id bigint, frame_idx int, flag boolean")
    assert [tuple(r)[1:] for r in S.runs(df, "flag").orderBy("run_id").collect()] == [(1, 1, 2, 2), (2, 5, 7, 3)]
    assert S.runs(df.where("not flag"), "flag").isEmpty()


def test_interpolation(spark):
    assert values(S.interpolated(path(spark, [None, 2, None, None, 8, None]))) == [2, 2, 4, 6, 8, 8]
    assert values(S.interpolated(path(spark, [None, None]))) == [None, None]


def test_interpolation_of_a_long_track_is_linear_work(spark):
    df = spark.range(100_000).selectExpr("1L as tracker_id", "cast(id as int) as frame_idx", "case when id % 100 = 0 then cast(id as double) end as x")
    began = time.monotonic()
    worst = S.interpolated(df, ("x",)).selectExpr("max(abs(x - least(frame_idx, 99900))) as d").first()["d"]
    assert worst < 1e-6 and time.monotonic() - began < 15


def test_nulls_are_no_reads_in_batch_and_stream(spark):
    reads = [None, None, None, "7", None, "7", "7", "8", "8", "8"]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(reads)], "tracker_id bigint, frame_idx int, value string")
    (row,) = S.validated(df, 3).collect()
    assert (row["value"], row["locked_at"]) == ("7", 6)
    assert validate.step((None, 0, None, None), list(range(10)), reads, 3)[2:] == ("7", 6)
    assert validate.step((None, 0, None, None), [0, 1], [float("nan"), None], 1) == (None, 0, None, None)


def test_smoothing_keeps_a_parabola_and_short_tracks(spark):
    xs = [0.5 * k * k - k for k in range(15)]
    assert np.allclose(values(S.smoothed(path(spark, xs))), xs, atol=1e-9)
    short = [1, 5, 2, 9, 3]
    assert values(S.smoothed(path(spark, short))) == short
    assert np.allclose(np.array(S.smoothing_weights()[4]) * 231, [-21, 14, 39, 54, 59, 54, 39, 14, -21])


def test_teleport_is_removed(spark):
    xs = [0.1 * k + 0.01 * (k % 2) for k in range(40)]
    xs[20] = 50.0
    got = S.cleaned(path(spark, xs))
    assert abs(values(got)[20] - 2.0) < 0.1
    assert [k for k, e in enumerate(values(got, "edited")) if e] == [18, 19, 20, 21, 22, 23]


def test_long_runs_of_jumps_stay(spark):
    s = replace(DEFAULTS, longest_jump_run=2)
    xs = [0.0, 0, 0, 0, 0, 0, 0, 0, 0, 5, 0, 5, 0, 5, 5, 5, 5, 5, 5, 5]
    got = S.short_runs(S.jumps(path(spark, xs), s), s)
    assert sum(values(got, "jump")) == 5 and not any(values(got, "short"))


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    r = random.Random(5)
    rows = [(t, k, r.choice("ab")) for t in range(15) for k in range(12)]
    ddl = "tracker_id bigint, frame_idx int, value string"
    for n, (lo, hi) in enumerate([(0, 4), (4, 8), (8, 12)]):
        spark.createDataFrame([x for x in rows if lo <= x[1] < hi], ddl).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    want = {tuple(x) for x in S.validated(spark.createDataFrame(rows, ddl), 3).collect()}

    def run(name):
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = validate.validated_stream(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive and q.exception() is None

    run("first")
    run("again")  # from the checkpoint: nothing new, nothing twice
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_loop_compares_the_boxes_of_all_frames_at_once(monkeypatch):
    r, ids = random.Random(3), ("frame_idx", "det_idx", "class_id", "tracker_id", "value", "x1", "y1", "x2", "y2")
    rows = [(f, k + 1, *r.choice([(2, r.randint(1, 3), None), (4, None, r.choice(["7", "8", None]))]), *(lambda x: (x, 0.0, x + 30.0, 30.0))(float(r.choice([0, 1, 40])))) for f in range(400) for k in range(r.randint(0, 5))]
    boxes, overlaps = pd.DataFrame(rows, columns=ids), loop.smaller_overlaps
    held, want = {}, []
    for f in range(400):  # one frame after the other, as a state machine
        own = [x for x in rows if x[0] == f]
        if f % 5 == 0:
            part = lambda p, n: max(0.0, min(p[7], n[7]) - max(p[5], n[5])) / 30
            for _, p, n in sorted((-part(p, n), p, n) for p in own for n in own if p[2] == 2 and n[2] == 4 and part(p, n) > 0.9):
                held[p[3]] = validate.step(held.get(p[3], (None, 0, None, None)), [f], [n[4]], 3)
        want += [(f, x[1], x[3], held.get(x[3], (None,) * 3)[2]) for x in own if x[2] == 2]
    for pairs in (4, 1 << 20):
        calls, tracks, got = [], {}, []
        monkeypatch.setattr(loop, "PAIRS", pairs)
        monkeypatch.setattr(loop, "smaller_overlaps", lambda a, b: calls.append(len(a)) or overlaps(a, b))
        for lo, hi in ((0, 150), (150, 400)):  # two batches with the state carried on
            out = loop._video(boxes[(boxes["frame_idx"] >= lo) & (boxes["frame_idx"] < hi)].reset_index(drop=True), tracks, DEFAULTS)
            got += [tuple(x) for x in out.astype(object).to_numpy()]
        assert got == want and len({x[3] for x in want}) > 1
        assert len(calls) == 2 if pairs > 4 else max(calls) <= 25


def test_idle_tracks_are_forgotten(spark, tmp_path):
    """The state of a track that the watermark has passed is dropped: its next reads start a new streak."""
    ddl = "tracker_id bigint, frame_idx int, value string"
    for n, rows in enumerate([[(1, 0, "a"), (1, 1, "a")], [(2, 900, "b")], [(2, 901, "b")], [(1, 902, "a"), (2, 902, "b")]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))

    def run(idle, name):
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        stream = validate.with_event_time(stream, "2025-01-01 00:00:00", 1.0)
        out = validate.validated_stream(stream, 3, idle=idle)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return {r["tracker_id"] for r in spark.read.schema("tracker_id bigint, value string, locked_at int").parquet(str(tmp_path / name)).collect()}

    assert run("60 seconds", "idle") == {2} and run("1 days", "kept") == {1, 2}


def test_event_time_windows(spark):
    df = spark.createDataFrame([(k, 2) for k in range(40)], "frame_idx int, class_id int")
    got = validate.counts_by_window(validate.with_event_time(df, "2025-01-01 00:00:00", 2.0), "10 seconds")
    assert sorted(r["n"] for r in got.collect()) == [20, 20]


def test_tracker_follows_the_first_frame(spark):
    rows = [(1, f, d, 10.0 * d + f, 0.0, 10.0 * d + f + 8, 8.0) for f in range(5) for d in (1, 2)]
    rows += [(1, 3, 3, 200.0, 0.0, 208.0, 8.0)]
    df = spark.createDataFrame(rows, "video_id bigint, frame_idx bigint, det_idx int, x1 double, y1 double, x2 double, y2 double")
    got = tracker.track(df).collect()
    assert len(got) == 10 and all(r["tracker_id"] == r["det_idx"] for r in got)
    t = tracker.Tracker()
    with pytest.raises(RuntimeError):
        t.propagate(np.zeros((1, 4)))
    with pytest.raises(ValueError):
        t.prompt(np.zeros((0, 4)))
