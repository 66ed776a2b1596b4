from __future__ import annotations

import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from pitchlake.llm import golay
from pitchlake.llm import packing as P

DDL = "doc_id bigint, text string, source string"


def brute_force(rows, capacity):
    """{(row, piece): bin} of rows (doc_id, source, cluster, n_bytes) that are already in order."""
    free, out = [], {}
    for r, (_, _, _, n) in enumerate(rows):
        for p in range(n // capacity):
            out[r, p] = len(free)
            free.append((0, set()))
    for r in sorted((r for r in range(len(rows)) if rows[r][3] % capacity), key=lambda r: -(rows[r][3] % capacity)):
        _, s, c, n = rows[r]
        fits = [(room, b) for b, (room, held) in enumerate(free) if room >= n % capacity and not held & {("s", s), ("c", c)}]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append((capacity, set()))
        free[b] = (free[b][0] - n % capacity, free[b][1] | {("s", s), ("c", c)})
        out[r, n // capacity] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    rows = [(k, r.choice(["a", "b", "c", "d", "e", None]), r.randint(0, 30), r.randint(1, 250)) for k in range(300)]
    df = pd.DataFrame(rows, columns=["doc_id", "source", "cluster", "n_bytes"])
    got = P.pack(df, 100)
    order = df.sort_values(["n_bytes", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable", na_position="last")
    want = brute_force([tuple(x) for x in order[["doc_id", "source", "cluster", "n_bytes"]].itertuples(index=False)], 100)
    assert {(x.row, x.piece): x.bin for x in got.itertuples()} == want


def checked(rows, got, capacity):
    """What holds for any packing: all bytes placed once, no bin too full, no source or copy twice in a bin."""
    size = Counter()
    for r in got:
        size[r["doc_id"]] += r["n_bytes"]
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").encode())
    assert +size == +want
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        used = sum(r["n_bytes"] for r in held)
        assert used <= capacity and {r["free"] for r in held} == {capacity - used}
        assert len({r["source"] for r in held}) == len(held)
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return bins


@pytest.mark.parametrize("shard_bytes", [P.SHARD_BYTES, 20_000])
def test_packing_of_documents(spark, shard_bytes):
    r = random.Random(3)
    rows = [(k, "x" * r.randint(0, 900), r.choice("abcdefgh")) for k in range(400)]
    got = P.pack_documents(spark.createDataFrame(rows, DDL), 500, shard_bytes).collect()
    bins = checked(rows, got, 500)
    text = {i: t for i, t, _ in rows}
    for held in bins.values():
        assert len({text[x["doc_id"]] for x in held}) == len(held)


def test_odd_rows(spark):
    rows = [(1, "same", "a"), (2, "same", "b"), (3, "same", None), (3, "same", None), (4, None, "a"), (5, "", "a"), (None, "é" * 10, "c"), (6, "z" * 1_000_000, "a"), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DDL + ", shard int, Cluster string, n_bytes int")
    got = P.pack_documents(df).collect()
    bins = checked(rows, got, P.CAPACITY)
    assert Counter(r["doc_id"] for r in got) == {1: 1, 2: 1, 3: 2, None: 1, 6: -(-1_000_000 // P.CAPACITY)}
    assert not any(sum(x["doc_id"] in (1, 2, 3) for x in held) > 1 for held in bins.values())  # copies never share a bin
    assert P.pack_documents(df.limit(0)).isEmpty()


def test_near_copies_never_share_a_bin(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(40)) + f" x{k % 2}", f"s{k}") for k in range(12)] + [(100 + k, f"other{k} words{k}", f"s{k}") for k in range(12)]
    df = spark.createDataFrame(rows, DDL)
    got = P.pack_documents(df, clusters=golay.groups(df)).collect()
    held = defaultdict(list)
    for r in checked(rows, got, P.CAPACITY).values():
        for x in r:
            held[x["doc_id"]] = [y["doc_id"] for y in r]
    assert all(sum(i < 100 for i in held[k]) == 1 for k in range(12))  # texts of equal words but for one


def test_a_hot_document_is_spread(spark):
    df = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "repeat('y', 100) as text", "concat('s', id % 7) as source")
    got = P.pack_documents(df, 1000, 20_000).collect()
    assert len(got) == 3000 and len({r["bin_id"] for r in got}) == 3000
    assert len({r["bin_id"] >> 32 for r in got}) > 8


def test_equal_pieces_tie_by_doc_id():
    df = pd.DataFrame({"doc_id": [3, 1, 2], "source": ["a", "b", "c"], "cluster": [1, 2, 3], "n_bytes": [50, 50, 50]})
    got = P.pack(df, 100)
    assert list(got["doc_id"]) == [1, 2, 3] and list(got["bin"]) == [0, 0, 1]
