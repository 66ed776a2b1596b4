from __future__ import annotations

import random
from collections import Counter

import pytest

from pitchlake.llm import mixing as M

from .brute import copies, water_filling

DDL = "doc_id bigint, text string, source string"


def made(seed, n=400):
    r = random.Random(seed)
    return [(k, "x" * r.randint(1, 300), r.choice(["a", "a", "a", "b", "c", "d"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("weights,cap,budget", [({"a": 1, "b": 9}, 4, None), ({"b": 50, "c": 50}, 2, None), ({"a": 3}, 1, 10_000), ({"a": 1}, 3, 10**9), ({}, 4, None), ({"a": 0}, 4, None), ({"a": 0.3, "b": 0.7}, 4, None), ({"a": 1.5, "b": 2.5, "c": 1e-6}, 2, None), ({"a": -1.0, "b": float("nan")}, 4, None)])
def test_equals_repeated_clamping(spark, seed, weights, cap, budget):
    rows = made(seed)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t)
    want = water_filling(sizes, weights, 1, cap, budget)
    df = spark.createDataFrame(rows, DDL)
    plan = {r["source"]: r["epochs"] for r in M.plan(df, weights, 1, cap, budget).collect()}
    assert plan.keys() == want.keys() and all(abs(plan[s] - want[s]) < 1e-9 for s in want)
    got = Counter(r["doc_id"] for r in M.mix(df, weights, 1, cap, budget).collect())
    assert got == +Counter({i: copies(i, t, want.get(s, 0), M.SEED) for i, t, s in rows})


def test_odd_rows(spark):
    rows = [(1, "abc", "a"), (1, "abc", "a"), (2, None, "a"), (3, "", "a"), (4, "text", None), (None, "text", "b"), (None, None, "b"), (5, None, "empty"), (6, "y" * 500_000, "long")]
    df = spark.createDataFrame([(*r, 7, 0.5, "z") for r in rows], DDL + ", COPY int, epochs double, draw string")
    got = M.mix(df, {"a": 1}, 1, 2).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "epochs", "draw", "copy"}
    count = Counter((r["doc_id"], r["text"] and r["text"][:4], r["source"]) for r in got)
    assert count[(1, "abc", "a")] == 4 and count[(4, "text", None)] == 2 and count[(2, None, "a")] == 2 and count[(3, "", "a")] == 2
    assert (5, None, "empty") not in count and count[(None, "text", "b")] == 2
    assert all(1 <= r["copy"] <= 2 for r in got)
    assert M.mix(df.limit(0)).isEmpty()


def test_many_sources(spark):
    """Sources by the hundred thousand, over several ranges: the level is that of repeated clamping."""
    n = 100_000
    df = spark.range(n).selectExpr("id as doc_id", "repeat('x', cast(1 + id % 97 as int)) as text", "concat('s', id) as source")
    sizes, weights = {f"s{k}": 1 + k % 97 for k in range(n)}, {"s0": 40.5, "s1": 0.25, "s96": 1000.0}
    want = water_filling(sizes, weights, 1.0, 3)
    got = {r["source"]: r["epochs"] for r in M.plan(df, weights, 1.0, 3).collect()}
    assert got.keys() == want.keys() and max(abs(got[s] - want[s]) for s in want) < 1e-9


def test_a_large_table_of_sources_is_joined_by_a_shuffle(spark, monkeypatch):
    df = spark.createDataFrame(made(3), DDL)
    want = sorted(tuple(r) for r in M.mix(df).collect())
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in M.mix(df).collect()) == want


def test_weights_of_any_names_in_sql(spark):
    import duckdb

    df = spark.createDataFrame([(k, "y" * (k + 1), s) for k, s in enumerate(["it's", "b", "b", None, "c"])], DDL)
    docs = df.toPandas().assign(lang="en", n_chars=1)  # noqa: F841
    weights = {"it's": 0.5, "b": 1.25}
    got = sorted((r["doc_id"], r["copy"]) for r in M.mix(df, weights, 0.75).collect())
    assert got == sorted(duckdb.sql(f"select doc_id, copy from ({M.sql(weights, 0.75, docs='docs')})").fetchall())


def test_copies_need_no_number(spark):
    df = spark.createDataFrame([(1, "abc", "a", 7)], DDL + ", copy int")
    got = M.mix(df, {"a": 1}, budget=6, copy=None).collect()
    assert [tuple(r) for r in got] == [(1, "abc", "a", 7)] * 2
