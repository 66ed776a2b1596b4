from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import bytesops as B
from pitchlake.llm import golay as G
from pitchlake.llm.components import components

DDL = "doc_id bigint, text string"


def prints(texts):
    return G.packed(G.sums(B.strings(pa.array(texts, pa.string()))))


def brute_force(rows):
    """{doc_id: kept} of (doc_id, text) by comparing all pairs."""
    rows = [(i, t) for i, t in rows if i is not None and t and any(c.isalnum() for c in t)]
    p = prints([t for _, t in rows])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in np.flatnonzero(G.apart(p[a], p[a + 1 :]) <= G.MAX_BITS) + a + 1:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return {i: min(g) for g in groups.values() for i in g if i != min(g)}


def made(seed, n=60):
    r = random.Random(seed)
    words = [f"word{k}" for k in range(3000)]
    rows = []
    for k in range(n):
        own = r.choices(words, k=r.randint(60, 200))
        rows.append(own)
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(own)
            for _ in range(r.randint(0, len(own) // 25)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(copy)
    r.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_code_has_distance_seven():
    words = (G.codewords() > 0).astype(int)
    assert len({tuple(w) for w in words}) == 4096
    weight = words.sum(1)  # a linear code: distances are weights
    assert weight[weight > 0].min() == 7


def test_nearest_codewords():
    total = np.random.default_rng(1).normal(size=(20, G.KEYED * G.BITS))
    near = G.keys(total)
    assert near.shape == (20, 35 * 8) and (near == G.keys(total)).all()
    fit = total[:, : G.BITS] @ G.codewords().T
    first = (near[:, 0] >> 24) & 4095  # of the first choice (segments 0, 1, 2), the key of all nearest
    assert (first == fit.argmax(1)).all()


def test_keys_reach_pairs_at_the_limit():
    """Of pairs that differ in 40 bits to the limit, nine in ten share a key; made by errors anywhere in the fingerprint."""
    r = np.random.default_rng(7)
    one = r.normal(size=(4000, G.SEGMENTS * G.BITS))
    two = 0.88 * one + (1 - 0.88**2) ** 0.5 * r.normal(size=one.shape)
    bits = ((one > 0) != (two > 0)).sum(1)
    far = (bits >= 40) & (bits <= G.MAX_BITS)
    a, b = (G.all_keys(x[far]) for x in (one, two))
    assert len(a) > 1000 and a.shape[1] == (35 + 20) * 8
    found = np.array([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b)])
    assert found.mean() >= 0.9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_copies_equal_brute_force(spark, seed):
    rows = made(seed)
    got = {r["doc_id"]: r["kept_doc_id"] for r in G.duplicates(spark.createDataFrame(rows, DDL)).collect()}
    want = brute_force(rows)
    assert len(want) > 20
    assert len(set(got) & set(want)) >= 0.98 * len(want) and all(want.get(i) == k or i in want for i, k in got.items())


def test_recall_and_precision_on_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["kept_doc_id"] for r in G.duplicates(docs).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, "same text of a few words"), (2, "same text of a few words"), (2, "same text of a few words"), (3, None), (4, ""), (5, "  "), (6, "..."), (7, "..."), (None, "same text of a few words"), (8, long), (9, long + " one more"), (10, "Same TEXT, of a few words!")]
    df = spark.createDataFrame([(*r, "x", 1, {"a": 1}) for r in rows], DDL + ", id string, Key int, m map<string,int>")
    got = {r["doc_id"]: (r["kept_doc_id"], r["group_size"]) for r in G.duplicates(df).collect()}
    assert got == {2: (1, 3), 10: (1, 3), 9: (8, 2)}
    kept = G.drop_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert G.duplicates(df.limit(0)).isEmpty() and G.drop_duplicates(df.limit(0)).isEmpty()


def test_texts_of_a_repeated_id_are_judged_each_for_itself(spark):
    one, two, own = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    df = spark.createDataFrame([(1, one), (5, one), (5, own), (5, own), (7, two), (7, two + " more"), (8, None), (8, None)], DDL)
    want = [(1, one), (5, own), (7, min(two, two + " more", key=lambda t: t)), (8, None)]
    got = [(r["doc_id"], r["text"]) for r in G.drop_duplicates(df).collect()]
    assert sorted(i for i, _ in got) == [1, 5, 7, 8] and set(got) - {(7, two), (7, two + " more")} == set(want) - {(7, two)}
    assert sorted((r["doc_id"], r["kept_doc_id"]) for r in G.duplicates(df).collect()) == [(5, 1), (7, 7)]


def test_order_and_repetition_count():
    words = [f"word{k}" for k in range(40)]
    one = " ".join(words)
    p = prints([one, " ".join(words[::-1]), " ".join([one] * 3), one + " end", ". ".join(words)])
    assert G.apart(p[0], p[1]) > G.MAX_BITS and G.apart(p[0], p[2]) > G.MAX_BITS
    assert G.apart(p[0], p[3]) <= G.MAX_BITS and G.apart(p[0], p[4]) == 0


@pytest.mark.parametrize("chunk", [2, 5, 16])
def test_hot_keys_in_chunks_lose_no_link(spark, chunk):
    """Families of distinct near copies and chains of them, with keys of more documents than a chunk."""
    rows = made(5, 25)
    r = random.Random(1)
    base = [f"base{k}" for k in range(150)]
    for k in range(60):  # one family
        copy = list(base)
        copy[r.randrange(150)] = f"x{k}"
        rows.append((1000 + k, " ".join(copy)))
    drift = list(base)
    for k in range(40):  # a chain that leaves the family step by step
        for _ in range(4):
            drift[r.randrange(150)] = f"y{r.random()}"
        rows.append((2000 + k, " ".join(drift)))
    df = spark.createDataFrame(rows, DDL)
    label = lambda c: {frozenset(g) for g in _grouped(G.groups(df, c).collect()).values()}
    assert label(chunk) == label(1 << 20)


def test_rows_of_shared_keys_with_the_numbers_of_their_chunks():
    r = np.random.default_rng(2)
    key = np.concatenate([np.full(900, 7), r.integers(100, 400, 700), np.full(3, 8)])
    r.shuffle(key)
    rows = [(int(k), i) for i, k in enumerate(key)]
    batches = [pa.record_batch([pa.array([k for k, _ in rows[lo : lo + 50]]), pa.array([i for _, i in rows[lo : lo + 50]])], ["key", "id"]) for lo in range(0, len(rows), 50)]
    for most in (20, 10_000):
        got = [x for b in G._shared(16, most)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
        many = {k for k in key if (key == k).sum() > 1}
        assert sorted((k, i) for k, _, i in got) == sorted(x for x in rows if x[0] in many)
        size = {}
        for k, c, _ in got:
            size[k, c] = size.get((k, c), 0) + 1
        assert max(size.values()) <= 16 and len([1 for k, _ in size if k == 7]) == -(-900 // 16)


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r["root"], []).append(r["doc_id"])
    return out


def test_thousands_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that is copied again and again").alias("text"))
    assert [r["doc_id"] for r in G.drop_duplicates(df).collect()] == [0]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    root = {}
    for a, b in edges:
        root.setdefault(a, {a})
        root.setdefault(b, {b})
        if root[a] is not root[b]:
            root[a] |= root[b]
            for x in root[b]:
                root[x] = root[a]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(g) for n, g in root.items() if len(g) > 1}
