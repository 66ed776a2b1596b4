from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pitchlake.llm import bytesops as B
from pitchlake.llm import quality as Q

DDL = "doc_id bigint, text string"


def plain_score(model, text):
    """The score of one document, passage by passage."""
    words = re.findall(rb"[^\x00-\x20]+", text.encode())
    bags = []
    for k in range(0, len(words), Q.PASSAGE_WORDS):
        x, _ = Q.passages(B.strings(pa.array([b" ".join(words[k : k + Q.PASSAGE_WORDS]).decode()])))
        bags.append(x[0].astype(float))
    if not bags:
        return 0.0
    p = {k: v.astype(float) for k, v in model.p.items()}
    codes, gates = [], []
    for x in bags:
        h = np.tanh(((x - model.mean) * model.scale) @ p["W"] + p["b"])
        codes.append(h)
        gates.append(float((np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"]))))) @ p["w"]))
    weight = [math.exp(g) / sum(math.exp(o) for o in gates) for g in gates]
    z = sum(w * h for w, h in zip(weight, codes))
    return 1 / (1 + math.exp(-float(z @ p["u"] + p["c"][0])))


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        good = r.random() < 0.6
        words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 300))]
        if not good:
            kind = r.randrange(3)
            words = [w + "%%%" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * len(words)
        rows.append((k, " ".join(words), int(good)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = made(400, 1)
    x, d = Q.passages(B.strings(pa.array([t for _, t, _ in rows])))
    return Q.fit(x, d, np.array([y for *_, y in rows], np.float32))


def test_held_out_accuracy(model):
    rows = made(300, 2)
    s = Q.score(model, pa.array([t for _, t, _ in rows])).field("score").to_numpy()
    assert ((s >= 0.5) == np.array([y for *_, y in rows])).mean() > 0.97


def test_scores_equal_one_document_at_a_time(model):
    texts = [t for _, t, _ in made(40, 3)] + ["", " \n", "one", "é ü " * 200]
    got = Q.score(model, pa.array(texts)).field("score").to_numpy()
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=2e-3)


def test_attention_goes_to_the_telling_passage():
    r = random.Random(7)
    line = lambda bad: " ".join("".join(r.choice("abcde") for _ in range(4)) + ("%%%" if bad else "") for _ in range(Q.PASSAGE_WORDS))
    texts, labels, where = [], [], []
    for k in range(300):
        bad = k % 2
        at = r.randrange(6)
        texts.append("\n".join(line(bad and i == at) for i in range(6)))
        labels.append(1 - bad)
        where.append(at)
    x, d = Q.passages(B.strings(pa.array(texts)))
    m = Q.fit(x, d, np.array(labels, np.float32))
    got = Q.score(m, pa.array(texts)).to_pylist()
    bad = [k for k in range(300) if not labels[k]]
    assert np.mean([got[k]["score"] < 0.5 for k in bad]) > 0.97
    assert np.mean([got[k]["top_passage"] == where[k] for k in bad]) > 0.9


def test_keeps_clean_test_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score_documents(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r["keep"] for r in got if r["quality"]], [r["keep"] for r in got if not r["quality"]]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.05


def test_odd_rows(spark):
    rows = [(k, t) for k, t, _ in made(60, 4)] + [(1000, None), (1001, ""), (1002, " \t\n"), (None, "some words here"), (1003, "word " * 200_000), (1004, "word"), (1004, "word"), (1005, "x" * 500_000)]
    df = spark.createDataFrame([(*r, 0.5, "s", True) for r in rows], DDL + ", Score double, quality_of string, keep boolean")
    marks = [(k, y, 0) for k, _, y in made(60, 4)] + [(None, 1, 0), (3, None, 0), (77777, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = Q.score_documents(df, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[k]["score"], by[k]["keep"], by[k]["n_passages"], by[k]["top_passage"]) == (0.0, False, 0, None) for k in (1000, 1001, 1002))
    assert by[1003]["n_passages"] == 3125 and by[1005]["n_passages"] == 1 and by[None]["n_passages"] == 1
    assert len({r["score"] for r in got if r["doc_id"] == 1004}) == 1
    kept = Q.keep_good(df, labels)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["keep"])
    assert Q.score_documents(df.limit(0), labels).isEmpty() and Q.keep_good(df.limit(0), labels).isEmpty()


def test_without_labels_of_both_classes_all_with_a_word_stay(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], DDL)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        assert {r["doc_id"]: (r["score"], r["keep"]) for r in Q.score_documents(df, lab).collect()} == {1: (0.5, True), 2: (0.0, False)}
