from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitchlake.functions import geometry as G
from pitchlake.functions import masks as M
from pitchlake.operators import filters, spatial

DDL = "image_id bigint, det_idx int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, *rows):
    return spark.createDataFrame([(i, k, c, float(s), *map(float, b)) for i, k, c, s, b in rows], DDL)


def ids(df, column="det_idx"):
    return sorted(r[column] for r in df.collect())


def test_touching_boxes_share_nothing(spark):
    df = boxes(spark, (1, 1, 2, 1, (0, 0, 10, 10)), (1, 2, 4, 1, (10, 0, 20, 10)))
    assert [r["ios"] for r in spatial.pairs(df).collect()] == [0.0]


def test_contained_box_has_full_overlap(spark):
    df = boxes(spark, (1, 1, 2, 1, (0, 0, 10, 10)), (1, 2, 4, 1, (2, 2, 4, 4)))
    (row,) = spatial.pairs(df).collect()
    assert row["ios"] == 1.0 and row["iou"] == pytest.approx(0.04)


def test_threshold_is_strict(spark):
    players = boxes(spark, (1, 1, 2, 1, (0, 0, 10, 10)))
    numbers = boxes(spark, (1, 2, 4, 1, (0, 5, 10, 15)))
    assert spatial.match(players, numbers, 0.5).isEmpty()
    assert spatial.match(players, numbers, 0.49).count() == 1
    with pytest.raises(ValueError):
        spatial.match(players, numbers, 0.5, strict=True)


def test_match_equals_nested_loops(spark):
    r = random.Random(1)
    make = lambda k, c: (r.randint(1, 4), k, c, 0.5, (x := r.randint(0, 20), y := r.randint(0, 20), x + r.randint(1, 9), y + r.randint(1, 9)))
    players, numbers = [make(k, 2) for k in range(1, 40)], [make(k, 4) for k in range(1, 40)]

    def ios(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
        return max(0, w) * max(0, h) / small

    want = []
    for f in range(1, 5):
        found = sorted((-ios(p[4], n[4]), p[1], n[1]) for p in players for n in numbers if p[0] == n[0] == f and ios(p[4], n[4]) > 0.3)
        want += [(f, p, n, k + 1) for k, (_, p, n) in enumerate(found)]
    got = spatial.match(boxes(spark, *players), boxes(spark, *numbers), 0.3).collect()
    assert sorted(want) == sorted((g["image_id"], g["p_idx"], g["n_idx"], g["pair_rank"]) for g in got)
    single = spatial.match(boxes(spark, *players), boxes(spark, *numbers), 0.3, one_to_one=True).collect()
    assert len({(g["image_id"], g["p_idx"]) for g in single}) == len(single)


def test_centre_on_the_border_is_inside(spark):
    box = boxes(spark, (1, 1, 4, 1, (0, 0, 10, 10)), (2, 1, 4, 1, (0, 0, 10, 10)))
    zone = boxes(spark, (1, 9, 3, 1, (5, 5, 8, 8)))
    assert ids(spatial.outside_all(box, zone), "image_id") == [2]


def test_suppression_chain_and_ties(spark):
    chain = boxes(spark, (1, 1, 4, 0.9, (0, 0, 10, 10)), (1, 2, 4, 0.8, (4, 0, 14, 10)), (1, 3, 4, 0.7, (9, 0, 19, 10)))
    assert ids(spatial.suppress(chain, 0.25)) == [1, 3]
    tied = boxes(spark, (1, 1, 4, 0.5, (0, 0, 10, 10)), (1, 2, 4, 0.5, (1, 0, 11, 10)))
    assert ids(spatial.suppress(tied, 0.25)) == [1]
    assert spatial.suppress(chain.limit(0), 0.25).isEmpty()


def test_suppression_equals_a_loop(spark):
    r = random.Random(2)
    rows = [(1, k, 4, r.randint(1, 9) / 10, (x := r.randint(0, 30), y := r.randint(0, 30), x + r.randint(2, 12), y + r.randint(2, 12))) for k in range(1, 60)]

    def iou(a, b):
        part = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return part / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - part)

    kept = []
    for row in sorted(rows, key=lambda x: (-x[3], x[1])):
        if all(iou(row[4], k[4]) <= 0.25 for k in kept):
            kept.append(row)
    assert ids(spatial.suppress(boxes(spark, *rows), 0.25)) == sorted(k[1] for k in kept)


def test_homography_recovers_a_projective_map(spark):
    m = np.array([[1.2, 0.1, 3], [0.05, 0.9, -2], [0.001, 0.002, 1]])
    src = np.array([[0, 0], [10, 1], [9, 12], [-1, 8], [5, 5.5]], float)
    h = np.c_[src, np.ones(5)] @ m.T
    assert np.allclose(spatial.homography(src, h[:, :2] / h[:, 2:]), m, atol=1e-9)


def test_frames_with_too_few_points_have_no_matrix(spark):
    pts = [(1, k, float(x), float(y), float(x * 2), float(y * 2)) for k, (x, y) in enumerate([(0, 0), (9, 1), (8, 9), (1, 7)])]
    pts += [(2, k, 1.0 * k, 2.0, 3.0, 4.0) for k in range(3)]
    df = spark.createDataFrame(pts, "frame_idx bigint, kp_idx int, x double, y double, cx double, cy double")
    got = spatial.fit_homographies(df, 4)
    assert ids(got, "frame_idx") == [1]
    at = spark.createDataFrame([(1, 3.0, 4.0), (2, 1.0, 1.0)], "frame_idx bigint, x double, y double")
    (row,) = spatial.to_court(at, got).collect()
    assert (row["court_x"], row["court_y"]) == (pytest.approx(6), pytest.approx(8))


def test_masks_round_trip_and_detached_parts(spark):
    df = boxes(spark, (1, 1, 2, 1, (2, 3, 5, 6)), (1, 2, 2, 1, (90, 90, 99, 99)))
    got = df.withColumn("m", M.box_to_mask(*G.box(), 64, 48)).select("det_idx", M.mask_area(F.col("m")).alias("n"), M.mask_to_box(F.col("m"), 64).alias("b")).orderBy("det_idx").collect()
    assert got[0]["n"] == 16 and tuple(got[0]["b"]) == (2, 3, 5, 6)
    assert got[1]["n"] == 0 and got[1]["b"] is None
    near, far = {"start": 7, "len": 1}, {"start": 40 * 64 + 60, "len": 2}
    kept = M.keep_near_segments([{"start": 0, "len": 6}, near, far], 64, 0.03)
    assert kept == [{"start": 0, "len": 6}, {"start": 7, "len": 1}]
    assert M.keep_near_segments([], 64, 0.03) == []
    same = spark.createDataFrame([([(0, 6), (2622, 2)],)], f"m {M.RUNS}").select(M.filter_segments(64)("m").alias("m")).first()["m"]
    assert [tuple(r) for r in same] == [(0, 6)]


def _pixels(runs):
    return {p for r in runs for p in range(r["start"], r["start"] + r["len"])}


def _near_by_pixels(pixels, width, relative):
    parts, left = [], set(pixels)
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            p = todo.pop()
            for q in [q for q in left if abs(q % width - p % width) <= 1 and abs(q // width - p // width) <= 1]:
                left.remove(q)
                part.add(q)
                todo.append(q)
        parts.append(part)
    parts.sort(key=lambda p: (-len(p), min(p)))
    x, y = [p % width for p in pixels], [p // width for p in pixels]
    limit = relative * np.hypot(max(x) - min(x) + 1, max(y) - min(y) + 1)
    gap = lambda a, b: min(np.hypot(p % width - q % width, p // width - q // width) for p in a for q in b)
    return set().union(*[p for p in parts if p is parts[0] or gap(parts[0], p) <= limit])


@pytest.mark.parametrize("seed", range(12))
def test_detached_parts_equal_a_search_by_pixel(seed):
    r = np.random.default_rng(seed)
    width = 12
    on = r.random(width * 10) < (0.25, 0.5)[seed % 2]
    runs = [{"start": int(p), "len": int(n)} for p, n in [(p, 1) for p in np.flatnonzero(on)]]
    kept = M.keep_near_segments(runs, width, 0.15)
    assert _pixels(kept) == _near_by_pixels(set(np.flatnonzero(on).tolist()), width, 0.15)
    assert all(r["start"] // width == (r["start"] + r["len"] - 1) // width for r in kept)
    assert len(_pixels(M.keep_near_segments([{"start": 5, "len": 100}], width, 0.1))) == 100  # a run that wraps rows


@pytest.mark.parametrize("pairs", [3, 1 << 20])
def test_detached_parts_of_many_masks_are_compared_at_once(monkeypatch, pairs):
    r, width, hypot, calls = np.random.default_rng(9), 40, np.hypot, []
    rows = [(k, int(a), int(n)) for k in range(300) for a, n in zip(r.integers(0, 1200, r.integers(1, 12)), r.integers(0, 50, 12))]
    want = [(k, a["start"], a["len"]) for k in range(300) for a in M.keep_near_segments([{"start": a, "len": n} for m, a, n in rows if m == k], width, 0.2)]
    monkeypatch.setattr(M, "PAIRS", pairs)
    monkeypatch.setattr(np, "hypot", lambda *a: calls.append(1) or hypot(*a))
    got = M.near_segments(*np.array(rows).T, width, 0.2)
    assert [tuple(map(int, x)) for x in zip(*got)] == want and len(want) > 600
    assert pairs == 3 or len(calls) == 2  # not one for each mask


def test_area_of_near_segments_and_boxes_of_no_pixels(spark):
    masks = spark.createDataFrame([(0, [(0, 6), (2622, 2)]), (1, []), (2, None), (3, [(70, 3)])], f"k int, m {M.RUNS}")
    got = masks.select("k", M.near_area(64)("m").alias("n"), M.mask_area(M.filter_segments(64)("m")).alias("want")).collect()
    assert {r["k"]: r["n"] for r in got} == {0: 6, 1: 0, 2: None, 3: 3} and all(r["n"] == r["want"] for r in got)
    boxes_ = [(0, 5.0, 9.0, 3.0, 2.0), (1, 60.0, 46.0, 90.0, 90.0), (2, -3.0, -2.0, 1.0, 0.0), (3, 0.0, 5.0, 9.0, 4.0)]
    df = spark.createDataFrame(boxes_, "k int, x1 double, y1 double, x2 double, y2 double").select("k", M.box_to_mask(*G.box(), 64, 48).alias("m"))
    assert df.schema["m"].dataType.simpleString() == M.RUNS
    assert {r["k"]: [tuple(x) for x in r["m"]] for r in df.collect()} == {0: [], 1: [(46 * 64 + 60, 4), (47 * 64 + 60, 4)], 2: [(0, 2)], 3: []}


def test_mask_intersection_equals_sets(spark):
    r = np.random.default_rng(4)
    made = lambda: [(int(a), int(b - a)) for a, b in np.sort(r.choice(60, (1, 8), False)).reshape(-1, 2)][: r.integers(0, 5)]
    rows = [(k, made(), made()) for k in range(60)]
    got = spark.createDataFrame(rows, f"k int, a {M.RUNS}, b {M.RUNS}").select("k", M.mask_intersection(F.col("a"), F.col("b")).alias("n"))
    sets = lambda m: {p for s, n in m for p in range(s, s + n)}
    assert {r["k"]: r["n"] for r in got.collect()} == {k: len(sets(a) & sets(b)) for k, a, b in rows}


def test_mask_overlap_of_nulls_empty_masks_and_runs_in_any_order(spark):
    one, runs = [(10, 5)], [(14, 0), (13, 9), (14, 0), (2, 3)]
    rows = [(0, one, runs), (1, runs, one), (2, None, one), (3, one, None), (4, None, []), (5, [], one), (6, [], []), (7, one, one)]
    df = spark.createDataFrame(rows, f"k int, a {M.RUNS}, b {M.RUNS}")
    got = df.select("k", M.mask_intersection(F.col("a"), F.col("b")).alias("n"), *[M.mask_overlap(F.col("a"), F.col("b"), m).alias(m) for m in ("ios", "iou")]).orderBy("k").collect()
    assert [r["n"] for r in got] == [2, 2, None, None, None, 0, 0, 5]
    assert [r["ios"] for r in got] == [0.4, 0.4, None, None, 0.0, 0.0, 0.0, 1.0]
    assert [r["iou"] for r in got] == [2 / 15, 2 / 15, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_masks_are_made_of_joined_pairs_and_compared_once(spark):
    plan = entry.queries()["mask_identity_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("== Initial Plan ==")[-1]
    assert tree.count("ArrowEvalPython") == 1
    join = tree.index("Join")
    assert "array_repeat" in tree[:join] and "array_repeat" not in tree[join:] and "transform(" not in tree


def test_filters(spark):
    df = boxes(spark, (1, 1, 1, 0.4, (0, 0, 10, 10)), (1, 2, 2, 0.5, (0, 0, 11, 10)), (1, 3, 4, 0.6, (0, 0, 1, 1)))
    assert ids(filters.confident(df, 0.4)) == [2, 3]
    assert ids(filters.larger(df, 100)) == [2]
    assert ids(filters.larger(df, 100, F.when(F.col("det_idx") == 3, 500))) == [2, 3]
    assert [r["tracker_id"] for r in filters.numbered(filters.of_classes(df, [2, 4])).orderBy("det_idx").collect()] == [1, 2]
    with pytest.raises(ValueError):
        filters.require(df.limit(0), "detection")
