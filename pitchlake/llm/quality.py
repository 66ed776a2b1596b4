"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE_WORDS`` words). Each passage is encoded from counts of
its bytes and words; gated attention, learned from the documents' labels alone, weighs the passages,
and the weighted sum of their codes is scored (Ilse, Tomczak and Welling, 2018).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .shared import fresh, others, q

PASSAGE_WORDS = 64
BUCKETS = 128
#: Labelled documents that the model is fitted on, at most; those with the least hash of their doc_id.
SAMPLE = 2500
HIDDEN = 24
ATTENTION = 12
EPOCHS = 20
#: A document is kept if its score is at least this.
KEEP_AT = 0.5
SEED = 6

_CLASS = np.full(256, 6, np.uint8)  # 6: other symbols
_CLASS[:33] = 0
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[128:] = 5
_CLASSES = 7
WIDTH = BUCKETS + 3 * _CLASSES + 5


def passages(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and which text it is of; a text without words has none."""
    data, offsets = B.buffers(column)
    start, end, row = B.runs(B.NOT_SPACE, data, offsets)
    if not len(row):
        return np.zeros((0, WIDTH), np.float32), row
    at = np.searchsorted(row, np.arange(len(column) + 1))
    first = np.flatnonzero((np.arange(len(row)) - at[row]) % PASSAGE_WORDS == 0)
    last = np.append(first[1:], len(row))
    n = len(first)
    words = (last - first).astype(np.float32)
    pid = np.repeat(np.arange(n), last - first)
    out = np.zeros((n, WIDTH), np.float32)
    h = B.hashes(B.LOWER[data], start, end)
    bag = np.bincount(pid * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(bag / words[:, None])
    kind = _CLASS[data]
    size = (end[last - 1] - start[first]).astype(np.float32)
    k = BUCKETS
    for c in range(_CLASSES):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == c, out=total[1:])
        out[:, k] = np.sqrt((total[end[last - 1]] - total[start[first]]) / size)
        k += 1
    for edge in (start, end - 1):
        held = np.bincount(pid * _CLASSES + kind[edge], minlength=n * _CLASSES).reshape(n, _CLASSES)
        out[:, k : k + _CLASSES] = held / words[:, None]
        k += _CLASSES
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    seen = np.sort(pid.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    distinct = np.bincount((seen[np.append(True, seen[1:] != seen[:-1])] >> np.uint64(40)).astype(np.int64), minlength=n)
    out[:, k] = np.bincount(pid, again, n) / words
    out[:, k + 1] = distinct / words
    out[:, k + 2] = np.log1p(words) / 4
    out[:, k + 3] = np.log1p(size / words) / 2
    out[:, k + 4] = np.bincount(pid, end - start == 1, n) / words
    return out, row[first]


@dataclass
class Model:
    """Arrays of the fitted network; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The score of each of n documents (not a number: no passage), and the attention on each passage."""
        code = np.tanh(((x - self.mean) * self.scale) @ self.p["W"] + self.p["b"])
        gate = np.tanh(code @ self.p["V"]) / (1 + np.exp(-(code @ self.p["U"])))
        weight = _softmax(gate @ self.p["w"], doc, n)
        z = _sum(code * weight[:, None], doc, n)
        score = 1 / (1 + np.exp(-(z @ self.p["u"] + self.p["c"])))
        return np.where(np.bincount(doc, minlength=n) > 0, score, np.nan), weight


def _sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by document; doc is in order."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(doc):
        at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        out[doc[at]] = np.add.reduceat(values, at, axis=0)
    return out


def _softmax(e: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    if not len(doc):
        return e
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    top = np.zeros(n, e.dtype)
    top[doc[at]] = np.maximum.reduceat(e, at)
    e = np.exp(e - top[doc])
    return e / _sum(e[:, None], doc, n)[doc, 0]


def fit(x: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit by Adam on batches of documents; both classes weigh the same. doc numbers the labels from 0, in order."""
    rng = np.random.default_rng(seed)
    scale = 1 / np.maximum(x.std(0), 0.02)
    model = Model(x.mean(0), scale.astype(np.float32), {
        "W": rng.normal(0, WIDTH**-0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
        "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "w": np.zeros(ATTENTION), "u": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(1),
    })
    p = model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    x = (x - model.mean) * model.scale
    bounds = np.searchsorted(doc, np.arange(len(label) + 1))
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    share, label = share.astype(np.float32), label.astype(np.float32)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), 128):
            chosen = order[lo : lo + 128]
            size = bounds[chosen + 1] - bounds[chosen]
            d = np.repeat(np.arange(len(chosen)), size)
            rows = np.repeat(bounds[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
            xb, n = x[rows], len(chosen)
            code = np.tanh(xb @ p["W"] + p["b"])
            t, s = np.tanh(code @ p["V"]), 1 / (1 + np.exp(-(code @ p["U"])))
            a = _softmax((t * s) @ p["w"], d, n)
            z = _sum(code * a[:, None], d, n)
            g = (1 / (1 + np.exp(-(z @ p["u"] + p["c"]))) - label[chosen]) * share[chosen] / n
            dz = (g[:, None] * p["u"])[d]
            da = (dz * code).sum(1)
            de = a * (da - _sum((a * da)[:, None], d, n)[d, 0])
            dts = de[:, None] * p["w"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dcode = (dz * a[:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - code * code)
            grad = {"W": xb.T @ dcode, "b": dcode.sum(0), "V": code.T @ dt, "U": code.T @ ds, "w": (t * s).T @ de, "u": z.T @ g, "c": g.sum(keepdims=True)}
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k in p:
                gk = grad[k] + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """The model from at most ``sample`` labelled documents; None where fewer than two of either class are there.

    Labels with a null id or quality are left out; of several for one document the lowest counts.
    """
    chosen = labels.select(q("doc_id").cast("long").alias("id"), q("quality").cast("int").alias("quality")).where("id is not null and quality is not null")
    chosen = chosen.groupBy("id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    rows = docs.select(q("doc_id").cast("long").alias("id"), q("text").alias("text")).where("text is not null").join(F.broadcast(chosen), "id")
    # Features leave the executors, not texts.
    schema = "id long, quality int, n int, x binary"

    def of(batches):
        for batch in batches:
            for part in B.slices(batch, "text"):
                x, doc = passages(B.strings(part.column("text")))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.record_batch([part.column("id"), part.column("quality"), pa.array(np.diff(at).astype(np.int32)), pa.array([x[i:j].astype(np.float16).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], ["id", "quality", "n", "x"])

    got = rows.mapInArrow(of, schema).where("n > 0").toPandas().sort_values(["id", "n", "x"]).drop_duplicates("id")
    label = (got["quality"] > 0).to_numpy(np.float32)
    if min((label == 1).sum(), (label == 0).sum()) < 2:
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit(x, np.repeat(np.arange(len(got)), got["n"]), label, seed=seed)


_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.IntegerType()), T.StructField("top_passage", T.IntegerType()), T.StructField("top_weight", T.DoubleType())])


def score(model: Model | None, column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """(score, n_passages, top_passage, top_weight) of each text of a column."""
    batch = pa.record_batch([B.strings(column)], ["text"])
    out = []
    for part in B.slices(batch, "text"):
        n = part.num_rows
        x, doc = passages(part.column(0))
        held = np.bincount(doc, minlength=n)
        if model is None:
            s, w = np.where(held > 0, 0.5, np.nan), (1 / np.maximum(held, 1))[doc]
        else:
            s, w = model.scores(x, doc, n)
        none = held == 0
        at = np.searchsorted(doc, np.arange(n))
        best = np.lexsort((np.arange(len(doc)), -w, doc))[at[~none]] if len(doc) else at[~none]
        top, weight = np.zeros(n, np.int32), np.zeros(n)
        top[~none], weight[~none] = best - at[~none], w[best]
        s = np.where(none, 0.0, s)
        out.append(pa.StructArray.from_arrays([pa.array(s.astype(np.float64)), pa.array(held.astype(np.int32)), pa.array(top, mask=none), pa.array(weight, mask=none)], names=_RESULT.names))
    arrow = pa.struct([("score", pa.float64()), ("n_passages", pa.int32()), ("top_passage", pa.int32()), ("top_weight", pa.float64())])
    return pa.concat_arrays([a.cast(arrow) for a in out]) if out else pa.array([], arrow)


def _scorer(model: Model | None) -> Column:
    @F.arrow_udf(_RESULT)
    def of(text: pa.Array) -> pa.Array:
        return score(model, text)

    return of.asNondeterministic()(q("text").cast("string"))  # else a filter on the score would run it twice


def score_documents(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, score, keep, n_passages, top_passage, top_weight) for every row of docs.

    ``score`` is the probability of good quality, ``top_passage`` the passage (from 0) with the most
    attention. A null or empty text, or one of white space, has no passage: score 0, not kept, no top
    passage. Whole texts are read, whatever their length. Rows that repeat a document get the same score
    each; ties in attention go to the earlier passage. A null doc_id is scored and carried as null.
    Without labels of both classes every document with a word scores 0.5 and is kept. An empty table
    gives no rows; other columns aren't looked at.
    """
    model = train(docs, labels)
    got = docs.select(q("doc_id").cast("long").alias("doc_id"), _scorer(model).alias("s"))
    return got.select("doc_id", "s.score", (F.col("s.score") >= keep_at).alias("keep"), "s.n_passages", "s.top_passage", "s.top_weight")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that ``score_documents`` keeps, with all their columns."""
    (name,) = fresh(docs, "quality_of")
    scored = docs.withColumn(name, _scorer(train(docs, labels)))
    return scored.where(q(name)["score"] >= keep_at).select([q(c) for c in others(scored, name)])
