"""The whole pipeline against plain Python, and the registered queries against their SQL."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pitchlake.llm import bytesops as B
from pitchlake.llm import golay, mixing, packing, quality
from pitchlake.llm.queries import QUERIES, SQL

from ..compare import assert_same, connect
from .brute import copies, water_filling
from .test_golay import brute_force as near_copies
from .test_packing import brute_force as pack_one_by_one
from .test_quality import plain_score

DIR = "/root/testdata/sf0.001"

PRIVATE = [
    ("SECRET", r"(?<=token = \")[0-9a-f]{40}(?=\")|(?<=TOKEN = \")[0-9A-F]{40}(?=\")"),
    ("EMAIL", r"[^\s@]+@mail\d\.example\.com"),
    ("PHONE", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("CARD", r"(?<!\d)\d{16}(?!\d)"),
    ("IP", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)"),
]


def plain_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if plain_score(model, r["text"]) >= quality.KEEP_AT]
    gone = near_copies([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if r["doc_id"] not in gone]
    for r in rows:
        for name, pattern in PRIVATE:
            r["text"] = re.sub(pattern, f"[{name}]", r["text"])
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"])
    epochs = water_filling(sizes, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.MAX_EPOCHS)
    rows = [r for r in rows for _ in range(copies(r["doc_id"], r["text"], epochs[r["source"]], mixing.SEED))]
    # Clusters are equal texts; among copies of a document the order doesn't show in the result.
    order = sorted(rows, key=lambda r: (-len(r["text"].encode()), r["doc_id"]))
    placed = pack_one_by_one([(r["doc_id"], r["source"], r["text"], len(r["text"].encode())) for r in order], packing.CAPACITY)
    return order, placed


def test_run_equals_plain_python(spark):
    order, placed = plain_run(spark)
    bins = defaultdict(list)
    for (row, piece), b in placed.items():
        bins[b].append((order[row]["doc_id"], piece))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, DIR).collect():
        got[r["bin_id"]].append((r["doc_id"], r["piece"]))
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted(v) for v in bins.values())


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DIR)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            assert 0 < docs.count() <= (before if name != "mix_sources" else 10 * before)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).isEmpty()


def test_near_copies_of_the_fixture_are_found_by_their_keys(spark):
    """That plain_run compares all pairs asks no more of the keys than they give here."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    p = golay.packed(golay.sums(B.strings(pa.array([r["text"] for r in docs]))))
    pairs = [(a, b) for a in range(len(p)) for b in np.flatnonzero(golay.apart(p[a], p[a + 1 :]) <= golay.MAX_BITS) + a + 1]
    assert pairs


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert_same(QUERIES[name](spark, d).toPandas(), connect(d).execute(SQL[name]).df())


def test_every_operator_has_a_query():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
