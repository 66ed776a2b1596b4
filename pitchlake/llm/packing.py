"""Best-fit packing of documents into sequences that no source and no duplicate cluster enters twice."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, q

#: Bytes in a sequence (a byte-level model's tokens).
CAPACITY = 8192
#: Bytes that are packed together; the number of such shards grows with the table.
SHARD_BYTES = 32 << 20
SCHEMA = "bin_id long, slot int, doc_id long, source string, piece int, start long, n_bytes int, free int"


class Bins:
    """Open bins in the order of (room left, number), and for each a bitmap of its sources and clusters, which stays in its place."""

    def __init__(self, marks: int, size: int = 64):
        self.key = np.zeros(size, np.int64)  # in order: room << 32 | number
        self.row = np.zeros(size, np.int64)  # in order: the bin's row of the bitmaps
        self.bits = np.zeros((size, -(-marks // 64)), np.uint64)
        self.spare = list(range(size))
        self.n = 0

    def _fitting(self, length: int, marks: list[int]) -> int:
        """The place of the first bin with enough room that holds none of the marks; n where there is none."""
        lo, step = int(np.searchsorted(self.key[: self.n], length << 32)), 32
        while lo < self.n:
            rows = self.row[lo : min(lo + step, self.n)]
            free = np.ones(len(rows), bool)
            for m in marks:
                free &= self.bits[rows, m >> 6] & np.uint64(1 << (m & 63)) == 0
            at = int(free.argmax())
            if free[at]:
                return lo + at
            lo, step = lo + step, step * 2
        return self.n

    def place(self, length: int, marks: list[int], number: int, capacity: int) -> tuple[int, int]:
        """The bin that the piece goes to, and its room then; ``number`` names a new one."""
        at = self._fitting(length, marks)
        if at < self.n:
            found, room, row = int(self.key[at] & 0xFFFFFFFF), int(self.key[at] >> 32) - length, self.row[at]
        else:
            if not self.spare:
                self.spare = list(range(len(self.bits), 2 * len(self.bits)))
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            if at == len(self.key):
                self.key, self.row = (np.append(a, np.zeros_like(a)) for a in (self.key, self.row))
            found, room, row = number, capacity - length, self.spare.pop()
            self.n += 1
        if not room:  # full: it leaves the order
            for a in (self.key, self.row):
                a[at : self.n - 1] = a[at + 1 : self.n].copy()
            self.bits[row] = 0
            self.spare.append(int(row))
            self.n -= 1
            return found, 0
        for m in marks:
            self.bits[row, m >> 6] |= np.uint64(1 << (m & 63))
        key = room << 32 | found
        to = int(np.searchsorted(self.key[:at], key))
        for a, v in ((self.key, key), (self.row, row)):
            a[to + 1 : at + 1] = a[to:at].copy()
            a[to] = v
        return found, room


def _marks(values: pd.Series, first: int) -> tuple[np.ndarray, int]:
    """A number from ``first`` on for each value that is there more than once, -1 for others; and the next number."""
    code = pd.factorize(values, use_na_sentinel=False)[0]
    many = np.bincount(code, minlength=1)[code] > 1 if len(code) else np.zeros(0, bool)
    out = np.full(len(code), -1)
    out[many] = first + np.unique(code[many], return_inverse=True)[1]
    return out, first + len(np.unique(code[many]))


def pack(rows: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Bins of one shard: rows (doc_id, source, cluster, n_bytes), to (bin, slot, row, piece, start, n_bytes, free)."""
    rows = rows.sort_values(["n_bytes", "doc_id", "cluster", "source"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
    size = rows["n_bytes"].to_numpy(np.int64)
    whole, tail = size // capacity, size % capacity
    source, n = _marks(rows["source"], 0)
    cluster, n = _marks(rows["cluster"], n)
    # Whole pieces fill bins of their own.
    full = np.repeat(np.arange(len(rows)), whole)
    piece = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    number = len(full)
    order = np.flatnonzero(tail > 0)
    order = order[np.argsort(-tail[order], kind="stable")]
    bins = Bins(max(1, n))
    got = np.zeros(len(order), np.int64)
    for k, r in enumerate(order):
        got[k], _ = bins.place(int(tail[r]), [int(m) for m in (source[r], cluster[r]) if m >= 0], number, capacity)
        number += got[k] == number
    out = pd.DataFrame({"bin": np.concatenate([np.arange(len(full)), got]), "row": np.concatenate([full, order]), "piece": np.concatenate([piece, whole[order]]), "n_bytes": np.concatenate([np.full(len(full), capacity), tail[order]])})
    out["start"] = out["piece"] * capacity
    out["slot"] = out.groupby("bin").cumcount()
    out["free"] = capacity - out.groupby("bin")["n_bytes"].transform("sum")
    for c in ("doc_id", "source"):
        out[c] = rows[c].to_numpy()[out["row"]]
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_bytes: int = SHARD_BYTES, clusters: DataFrame | None = None) -> DataFrame:
    """Which bytes of which document go to which sequence: (bin_id, slot, doc_id, source, piece, start, n_bytes, free).

    A text of more than ``capacity`` bytes is cut at its multiples; each whole piece is a sequence of
    its own. The rest, longest first, go each to the open bin with the least room that is enough and
    that holds no piece of the same source or of the same duplicate cluster: bins stand in the order
    of (room, number), and the search goes on from the first with enough room until one is compatible;
    if none is, a new one is opened. ``free`` is the room left in the bin at the end.

    ``clusters`` (doc_id, text_hash, root), as ``golay.groups`` gives them, says which documents are near copies; without it,
    and for documents that aren't in it, equal texts are a cluster.

    The rows are spread by hash over as many shards as their bytes need, each packed by itself; only
    lengths and hashes are moved, not texts. Null and empty texts take no room and aren't placed. A null
    source is a source of its own; a null doc_id is carried as it is. Rows that repeat a document never
    share a bin; they are counted before they are moved and spread over the shards, too. An empty table gives no rows;
    other columns are not looked at.
    """
    meta = docs.select(q("doc_id").cast("long").alias("doc_id"), q("source").cast("string").alias("source"), F.xxhash64(q("text")).alias("text_hash"), F.octet_length(q("text")).cast("long").alias("n_bytes")).where("n_bytes > 0")
    meta = meta.groupBy("doc_id", "source", "text_hash", "n_bytes").agg(F.count("*").alias("copies"))
    if clusters is None:
        meta = meta.withColumn("cluster", F.col("text_hash"))
    else:
        known = clusters.select(F.col("doc_id").alias("member"), F.col("text_hash").alias("of"), F.xxhash64(F.lit("group"), "root").alias("cluster"))
        meta = meta.join(known, (F.col("doc_id") == F.col("member")) & (F.col("text_hash") == F.col("of")), "left").withColumn("cluster", F.coalesce("cluster", "text_hash"))
    meta = cut(meta.select("doc_id", "source", "text_hash", "cluster", "n_bytes", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))
    shards = max(1, -(-(meta.agg(F.sum("n_bytes")).first()[0] or 0) // shard_bytes))
    spread = F.pmod(F.xxhash64("doc_id", "text_hash", "copy", F.lit(8)), F.lit(shards)).cast("long")

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        out = pack(rows, capacity)
        out["bin_id"] = out["bin"] + (int(key[0]) << 32)
        return out[["bin_id", "slot", "doc_id", "source", "piece", "start", "n_bytes", "free"]]

    slim = meta.select("doc_id", "source", "cluster", "n_bytes", spread.alias("shard"))
    return slim.groupBy("shard").applyInPandas(of, SCHEMA)
