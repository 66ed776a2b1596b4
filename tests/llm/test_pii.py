from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from pitchlake.llm import bytesops as B
from pitchlake.llm import pii as P


@pytest.fixture(scope="module")
def weights():
    return P.fit()


def found(text, weights):
    (r,) = P.redact_column(pa.array([text], pa.string()), weights).to_pylist()
    return [] if r is None else [(e["label"], text[e["start"] : e["end"]]) for e in r["entities"]]


def best_labels(unary, edges, pair):
    """By trying every labelling."""
    n, k = unary.shape
    best, at = -np.inf, None
    for y in itertools.product(range(k), repeat=n):
        score = sum(unary[i, y[i]] for i in range(n)) + sum(pair[t, y[i], y[j]] for i, j, t in edges)
        if score > best:
            best, at = score, y
    return np.array(at), best


def test_messages_are_exact_without_loops():
    r = np.random.default_rng(1)
    for _ in range(20):
        unary, pair = r.normal(size=(6, 3)), r.normal(size=(3, 3, 3))
        edges = np.array([(0, 1, 0), (1, 2, 0), (1, 3, 1), (3, 4, 2)])  # a tree; node 5 by itself
        old, P.K = P.K, 3
        try:
            got = P.infer(unary, edges, pair, rounds=60)
        finally:
            P.K = old
        assert (got == best_labels(unary, edges, pair)[0]).all()


def test_marginals_are_exact_without_loops():
    r = np.random.default_rng(3)
    unary, pair = r.normal(size=(6, 3)), r.normal(size=(3, 3, 3))
    edges = np.array([(0, 1, 0), (1, 2, 0), (1, 3, 1), (3, 4, 2)])
    node, both = P.marginals(unary, edges, pair, rounds=40)
    every = list(itertools.product(range(3), repeat=6))
    p = np.exp([sum(unary[i, y[i]] for i in range(6)) + sum(pair[t, y[i], y[j]] for i, j, t in edges) for y in every])
    p /= p.sum()
    want = np.zeros((6, 3))
    for y, x in zip(every, p):
        want[np.arange(6), y] += x
    assert np.allclose(node, want, atol=1e-4)
    for (i, j, _), b in zip(edges, both):
        table = np.zeros((3, 3))
        for y, x in zip(every, p):
            table[y[i], y[j]] += x
        assert np.allclose(b, table, atol=1e-4)


def test_messages_are_close_with_loops():
    r = np.random.default_rng(2)
    same = 0
    for _ in range(30):
        unary, pair = r.normal(size=(7, 3)), np.stack([np.eye(3) * 0.8] * 3)
        edges = np.array([(k, k + 1, 0) for k in range(6)] + [(0, 4, 1), (2, 6, 2)])
        old, P.K = P.K, 3
        try:
            got = P.infer(unary, edges, pair)
        finally:
            P.K = old
        want, best = best_labels(unary, edges, pair)
        score = unary[np.arange(7), got].sum() + sum(pair[t, got[i], got[j]] for i, j, t in edges)
        assert score > best - 1.5
        same += (got == want).all()
    assert same >= 25


@pytest.mark.parametrize("n,pull", [(38, 0.1), (201, 0.1), (3000, 0.01)])
def test_a_clear_mention_settles_all_bare_ones(n, pull):
    """A chain is a tree, so the messages are exact: to relabel all costs pull for each, and not to costs 50 at once."""
    unary = np.zeros((n, 2))
    unary[1:, 0] = pull
    unary[0, 1] = 50
    chain = np.array([(k, k + 1, P.SAME) for k in range(n - 1)])
    old, P.K = P.K, 2
    try:
        got = P.infer(unary, chain, np.stack([np.eye(2) * 100] * 3))
        assert (got == 1).all()
        weak = P.infer(np.concatenate([unary, unary]), np.concatenate([chain, chain + [n, n, 0]]), np.stack([np.eye(2) * 2] * 3))
        lone = P.infer(unary, chain, np.stack([np.eye(2) * 2] * 3))
    finally:
        P.K = old
    assert (weak == np.concatenate([lone, lone])).all()


def test_a_clear_mention_settles_200_bare_ones_of_a_text(weights):
    sha = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    bare = " ".join(["words words", sha] * 200)
    n = P.nodes(B.strings(pa.array([f"token = {sha} {bare}"])))
    u = P.unaries(weights, n.features)
    # The bare mentions are slightly towards O, so that only the first one can settle them.
    u[1:] = u[1:].min()
    u[1:, P.NUMBER["O"]] = 0.01
    u[1:, P.NUMBER["SECRET"]] = 0
    u[0, P.NUMBER["SECRET"]] = u[0].max() + 50
    pair = np.stack([np.eye(P.K) * 100] * 3)
    assert len(n.row) == 201 and (P.infer(u, n.edges, pair) == P.NUMBER["SECRET"]).all()
    assert (P.infer(u, n.edges, pair, rounds=P.ROUNDS) == P.NUMBER["SECRET"]).sum() < 201


def test_held_out_accuracy_and_what_the_skips_add(weights):
    n, y = P.labelled(P.generated(500, 4242))
    u = P.unaries(weights, n.features)
    accuracy = (P.infer(u, n.edges, weights.pair) == y).mean()
    without = (P.infer(u, n.edges[n.edges[:, 2] == P.CHAIN], weights.pair) == y).mean()
    assert accuracy > 0.985 and accuracy > without


@pytest.mark.parametrize("text,want", [
    ("write to ann.lee9@mail7.example.com.", [("EMAIL", "ann.lee9@mail7.example.com")]),
    ("und.34@mail7.example.com!! and", [("EMAIL", "und.34@mail7.example.com")]),
    ("call +1 (017) 555-7713 now", [("PHONE", "+1 (017) 555-7713")]),
    ("é 9807915762804490%%% and 12 of 3", [("CARD", "9807915762804490")]),
    ("from 97.51.17.173, then", [("IP", "97.51.17.173")]),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', [("SECRET", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
    ('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', [("SECRET", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]),
    ("SSN 078-05-1120 here", [("ID", "078-05-1120")]),
    ("Licensed under the Apache License, Version 2.0.", []),
    ("Licensed under CC BY-NC 4.0.", []),
    ("in 1999 there were 25 of 300, page 12, 3.50 each", []),
    ("7536784127813050 4845168114407329", [("CARD", "7536784127813050"), ("CARD", "4845168114407329")]),
    ("password: hunter", [("SECRET", "hunter")]),
    ("token=abcdefghijklmnop", [("SECRET", "abcdefghijklmnop")]),
    ("the key: it is not", []),
    ("and token of the key", []),
    ("ISBN 9780306406157 and", []),
    ("at 1609459200000 it", []),
    ("call (020) 7946 0958 now", [("PHONE", "020) 7946 0958")]),
    ("Donaudampfschifffahrtsgesellschaft", []),
    ("", []), ("no digits at all", []), (None, []),
])
def test_cases(weights, text, want):
    assert found(text, weights) == want


def test_a_clear_mention_settles_a_distant_one(weights):
    sha = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    filler = " ".join(["words"] * 300)
    text = f'token = "{sha}" {filler} {sha}'
    assert [v for _, v in found(text, weights)] == [sha, sha]
    commit = f"commit {sha} {filler} commit {sha}"
    assert found(commit, weights) == []


def test_the_test_documents_lose_what_patterns_find(spark, weights):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b|\b[0-9a-fA-F]{40}\b")
    left = {r["doc_id"]: r["text"] for r in P.redact(docs).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    hit = {i for i, t in before.items() if patterns.search(t)}
    assert len(hit) > 30 and not [i for i, t in left.items() if patterns.search(t)]
    assert {i for i in before if left[i] != before[i]} == hit == {r["doc_id"] for r in P.find(docs).collect()}


def test_odd_rows(spark):
    card = "9807915762804490"
    rows = [(1, card, 16), (1, card, 16), (2, None, None), (3, "", 0), (None, "x " + card, 18), (4, "w " * 300_000 + card, 600_016), (5, "plain", 5), (6, f"{card} " * 2000, None)]
    df = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id bigint, text string, n_chars bigint, Redacted string, entities int")
    got = P.find(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_entities"]) for r in got) == [(0, 1), (1, 1), (1, 1), (4, 1), (6, 2000)]
    assert not any(card in r["text"] for r in got)
    whole = P.redact(df)
    assert whole.columns == df.columns and whole.count() == len(rows)
    assert {(r["doc_id"], r["n_chars"], len(r["text"] or "")) for r in whole.collect()} == {(1, 6, 6), (2, None, 0), (3, 0, 0), (None, 8, 8), (4, 600_006, 600_006), (5, 5, 5), (6, None, 14_000)}
    assert P.find(df.limit(0)).isEmpty() and P.redact(df.limit(0)).isEmpty()


def test_offsets_count_characters(weights):
    text = "éü " * 50 + "97.51.17.173"
    (r,) = P.redact_column(pa.chunked_array([[text]]), weights).to_pylist()
    assert r["text"] == "éü " * 50 + "[IP]" and r["entities"] == [{"label": "IP", "start": 150, "end": 162}]
    assert len(P.nodes(B.strings(pa.array([], pa.string()))).row) == 0
