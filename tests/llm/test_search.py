from __future__ import annotations

import numpy as np
import pytest

from pitchlake.llm import balltree, permutation
from pitchlake.llm import vectors as V

DDL = "vec_id bigint, embedding array<float>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(f) for f in v]) for i, v in zip(range(len(x)) if ids is None else ids, x)], DDL)


def exact(x, ids, k):
    s = (x[:, None] * x[None]).sum(2)
    np.fill_diagonal(s, -np.inf)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, : min(k, len(x) - 1)]
    return {int(i): [(int(ids[j]), round(float(s[r, j]), 6)) for j in row] for r, (i, row) in enumerate(zip(ids, order))}


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append((r["neighbor_id"], round(r["score"], 6)))
        assert r["rank"] == len(out[r["vec_id"]])
    return out


def made(n, d, seed):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(8, d))[r.integers(0, 8, n)] + 0.5 * r.normal(size=(n, d))).astype(np.float32)
    x[n // 2 :: 7] = x[0]  # equal vectors
    return x.astype(np.float64)


@pytest.mark.parametrize("n,shard_rows", [(300, 10_000), (500, 60), (7, 3)])
def test_ball_tree_equals_brute_force(spark, n, shard_rows):
    x = made(n, 12, n)
    ids = np.arange(n) * 3 + 1
    got = listed(balltree.top_k(frame(spark, x, ids), 5, shard_rows=shard_rows))
    want = exact(x, ids, 5)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for i in want for a, b in zip(got[i], want[i]))


def test_tree_prunes():
    x = np.concatenate([np.random.default_rng(k).normal(c, 0.05, (400, 6)) for k, c in enumerate((-5, 5))])
    tree = balltree.build(x)
    assert sorted(tree.order) == list(range(800)) and tree.end[0] == 800
    for c, r, lo, hi in zip(tree.center, tree.radius, tree.start, tree.end):
        assert np.sqrt(((x[tree.order[lo:hi]] - c) ** 2).sum(1)).max() <= r + 1e-9
    s, f = balltree.search(x[tree.order], tree.order, tree, x[:10], np.arange(10), 3, np.full(10, 1e9))
    assert (f == -1).all()  # nothing reaches the floor


@pytest.mark.parametrize("scale", [1e-150, 3e-6, 1.0, 1e100, 1e148])
def test_ball_tree_is_exact_at_any_scale(scale):
    x, ids = made(600, 10, 2) * scale, np.arange(600)
    tree = balltree.build(x, 32)
    s, f = balltree.search(x[tree.order], ids[tree.order], tree, x, ids, 5, np.full(600, -np.inf))
    want = exact(x, ids, 5)
    assert all([int(j) for j in f[i]] == [j for j, _ in want[i]] for i in range(600))


def test_queries_are_the_rows_of_divisible_ids(spark, monkeypatch):
    x = made(90, 8, 4)
    monkeypatch.setattr(V.query_blocks, "__defaults__", (1 << 8,))  # several blocks
    ids = np.arange(90) - 40
    df, asked = frame(spark, x, ids), {int(i) for i in ids if i % 7 == 0}
    got, want = listed(balltree.top_k(df, 3, every=7, shard_rows=30)), exact(x, ids, 3)
    assert set(got) == asked and all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in asked)
    got = listed(permutation.neighbors(df, 3, every=7, shard_rows=30))
    assert set(got) == asked and all(len(v) == 3 for v in got.values())


def test_huge_elements_count_as_infinite(spark):
    df = spark.createDataFrame([(1, [1e200, 0.0]), (2, [0.0, 0.0]), (3, [1e149, 1.0]), (4, [1e140, 0.0])], "vec_id bigint, embedding array<double>")
    got = listed(balltree.top_k(df, 5))
    assert {i: [j for j, _ in v] for i, v in got.items()} == {2: [3, 4], 3: [4, 2], 4: [3, 2]}


@pytest.mark.parametrize("search", [lambda df: balltree.top_k(df, 3), lambda df: permutation.neighbors(df, 3)])
def test_odd_rows(spark, search):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (2, [0.8, 0.6]), (3, None), (None, [1.0, 1.0]), (4, [1.0]), (5, [nan, 0.0]), (6, [0.0, 1.0]), (7, []), (8, [None, 1.0]), (9, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], DDL + ", ID int, shard string, score double")
    got = listed(search(df))
    assert set(got) == {1, 2, 6, 9} and all(len(v) == 3 for v in got.values())
    assert got[1] == [(2, 0.8), (6, 0.0), (9, 0.0)]  # ties go to the lower id
    assert search(df.limit(0)).isEmpty() and search(df.limit(1)).isEmpty()


def test_equal_vectors_all_tie(spark):
    df = frame(spark, np.ones((30, 4)))
    for got in (listed(balltree.top_k(df, 3, shard_rows=10)), listed(permutation.neighbors(df, 3))):
        assert [j for j, _ in got[0]] == [1, 2, 3] and [j for j, _ in got[29]] == [0, 1, 2]


def places(order, pivots, posted):
    place = np.full((len(order), pivots), posted)
    np.put_along_axis(place, order.astype(int), np.arange(order.shape[1])[None].repeat(len(order), 0), 1)
    return place


def test_footrule_from_inverted_files():
    r = np.random.default_rng(1)
    x, pivots = r.normal(size=(50, 6)), r.normal(size=(20, 6))
    o = permutation.orders(x, pivots, 8)
    files = permutation.inverted(o, 20)
    assert files.start[-1] == 50 * 8
    place = places(o, 20, 8)
    for k in range(10):
        for probed in (3, 8):
            mine = o[k, :probed].astype(int)
            assert (permutation.footrule(files, 50, o[k, :probed], 8) == np.abs(place[:, mine] - np.arange(probed)).sum(1)).all()


@pytest.mark.parametrize("n,share", [(400, 0.05), (400, 0.4)])
def test_permutation_index_equals_brute_force(spark, monkeypatch, n, share):
    """The index's own answer: all footrule distances, the rank cut, the cosines of those within."""
    monkeypatch.setattr(permutation, "LEAST_SHARDS", 1)
    x = made(n, 10, 3)
    df = frame(spark, x)
    got = listed(permutation.neighbors(df, 4, every=5, pivots=40, posted=16, probed=6, share=share))
    unit = permutation.normal(x)
    pivots = permutation.normal(V.sample(V.clean(df)[0], 40, permutation.SEED))
    o = np.argsort(-np.round(unit @ pivots.T, 6), axis=1, kind="stable")
    place = places(o[:, :16], 40, 16)
    for i in range(0, n, 5):
        d = sum(abs(place[:, p] - k) for k, p in enumerate(o[i, :6]))
        here = [j for j in range(n) if d[j] <= sorted(d)[max(permutation.LEAST_RERANKED, int(np.ceil(share * n))) - 1] and j != i]
        want = sorted((-float((unit[j] * unit[i]).sum()), j) for j in here)[:4]
        assert [j for j, _ in got[i]] == [j for _, j in want]


@pytest.mark.parametrize("n,d,shard_rows", [(60, 8, 10_000), (900, 16, 10_000), (900, 16, 250)])
def test_permutation_index_recall(spark, n, d, shard_rows):
    x = made(n, d, 5)
    x = x / np.sqrt((x**2).sum(1, keepdims=True))
    got = listed(permutation.neighbors(frame(spark, x), shard_rows=shard_rows))
    want = exact(x.astype(np.float32).astype(np.float64), np.arange(n), 10)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in got]) >= 0.9


def test_permutation_index_recall_on_the_test_vectors(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = t.toPandas()
    want = exact(np.stack(p["embedding"]).astype(np.float64), p["vec_id"].to_numpy(), 10)
    got = listed(permutation.neighbors(t, every=permutation.EVERY))
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 10 for i in got]) >= 0.9
