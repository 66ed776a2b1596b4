"""Near-duplicate documents: SimHash fingerprints cut into 23-bit segments that are decoded with the
binary Golay code [23, 12, 7] to nearby codewords.

A fingerprint has ``SEGMENTS`` segments, which are keyed in two sets, the first ``KEYED`` and the last ``LAST``, so
that errors that crowd in the one are few in the other. The segments are decoded: each gives the
indices of its two nearest codewords, where a bit's share of the distance is how far its sum was from
zero (an unsure bit is cheap to change). By the pigeonhole principle, few errors in the segments of a set
leave some ``CHOSEN`` of them with few errors each, so every choice of ``CHOSEN`` segments of a set, with every
choice of one codeword for each, is a key of the document. Documents that share a key are candidates;
a candidate pair counts when the whole fingerprints differ in at most ``MAX_BITS`` bits. Groups are the
connected components of these pairs, and the smallest doc_id of a group is the one that stays.

Words are longest runs of ASCII letters, digits and non-ASCII bytes, ASCII letters in lower case. What a fingerprint is made of
are the words and the pairs of neighbouring words, each numbered by its occurrences: the second 'the' of a
document is another feature than the first, so that order and repetition count.

Hot keys: the documents of a key are compared in chunks of ``CHUNK``. Where a key has more than one, those of its documents
that aren't in the key's largest component after that are compared with all of its chunks, so that no link is lost and
no task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .shared import cut, fresh, q

BITS = 23
SEGMENTS = 12
KEYED = 7
LAST = 6
CHOSEN = 3
NEAREST = 2
#: Of 276 bits; a sixth of the bits means a cosine of 0.86 between the sets of features.
MAX_BITS = 47
_WORDS = -(-SEGMENTS * BITS // 64)
SLOTS = 1 << 12
#: Keys of one partition, about.
PARTITION_ROWS = 4_000_000
#: Documents of one key that are compared at once.
CHUNK = 8192


@lru_cache(1)
def codewords() -> np.ndarray:
    """The 4,096 codewords as rows of +1 and -1, from the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1."""
    words = np.zeros(1 << 12, np.int64)
    for i in range(12):
        words ^= np.where(np.arange(1 << 12) >> i & 1, 0b101011100011 << i, 0)
    return ((words[:, None] >> np.arange(BITS) & 1) * 2 - 1).astype(np.float32)


@lru_cache(1)
def _signs() -> np.ndarray:
    """Random rows of +1 and -1, one for each slot that words are hashed to."""
    return np.random.default_rng(23).choice(np.array([-1, 1], np.float32), (SLOTS, SEGMENTS * BITS))


def sums(column: pa.LargeStringArray) -> np.ndarray:
    """The sums whose signs are the fingerprints, a row for each text; all zero where there is no word.

    Each feature adds +1 or -1 (by its hash) to one of ``SLOTS`` slots; the slots are projected at once.
    """
    data, offsets = B.buffers(column)
    start, end, row = B.runs(B.ALNUM, data, offsets)
    out = np.zeros((len(column), SEGMENTS * BITS), np.float32)
    if not len(row):
        return out
    word = B.hashes(B.LOWER[data], start, end)
    near = row[1:] == row[:-1]
    pair = B.mix(word[:-1][near] * np.uint64(0x9E3779B97F4A7C15) + word[1:][near])
    key = np.concatenate([word, pair]) >> np.uint64(24) | np.concatenate([row, row[1:][near]]).astype(np.uint64) << np.uint64(40)
    key.sort()
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    nth = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    row = (key >> np.uint64(40)).astype(np.int64)
    key = B.mix((key << np.uint64(24)) + nth.astype(np.uint64))
    slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
    sign = np.where(key >> np.uint64(30) & np.uint64(1), 1.0, -1.0)
    at = np.searchsorted(row, np.arange(len(column) + 1))
    for lo in range(0, len(column), 1024):
        hi = min(lo + 1024, len(column))
        i, j = at[lo], at[hi]
        held = np.bincount((row[i:j] - lo) * SLOTS + slot[i:j], sign[i:j], (hi - lo) * SLOTS)
        out[lo:hi] = held.reshape(hi - lo, SLOTS).astype(np.float32) @ _signs()
        out[lo:hi][at[lo + 1 : hi + 1] > at[lo:hi]] += np.float32(0.5)  # no sum is exactly zero, so an all-zero row means no word
    return out


def packed(total: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 64-bit words: the signs of the sums."""
    bits = np.zeros((len(total), _WORDS * 64), np.uint8)
    bits[:, : total.shape[1]] = total > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def shares(total: np.ndarray) -> np.ndarray:
    """The sums as bytes, as shares of the greatest of each fingerprint: what decoding takes for how sure a bit is."""
    most = np.maximum(np.abs(total).max(1, keepdims=True), 1e-9) if len(total) else 1
    return np.rint(total / most * 127).astype(np.int8)


def keys(total: np.ndarray, keyed: int = KEYED, number: int = 0) -> np.ndarray:
    """The keys of the first ``keyed`` segments of each document, a row of C(keyed, CHOSEN) * NEAREST ** CHOSEN.

    Choices of segments are told apart by numbers from ``number`` on.
    """
    near = np.empty((len(total), keyed, NEAREST), np.int64)
    words = codewords().T
    for lo in range(0, len(total), 1024):
        for s in range(keyed):
            fit = total[lo : lo + 1024, s * BITS : (s + 1) * BITS].astype(np.float32) @ words
            best = fit.argmax(1)
            near[lo : lo + 1024, s, 0] = best
            for k in range(1, NEAREST):
                fit[np.arange(len(fit)), best] = -np.inf
                best = fit.argmax(1)
                near[lo : lo + 1024, s, k] = best
    out = []
    for n, chosen in enumerate(combinations(range(keyed), CHOSEN), number):
        key = np.full((len(total), 1), n, np.int64)
        for s in chosen:
            key = (key[:, :, None] << 12 | near[:, s, None, :]).reshape(len(total), -1)
        out.append(key)
    return np.concatenate(out, axis=1)


def all_keys(total: np.ndarray) -> np.ndarray:
    """The keys of both sets of segments."""
    return np.concatenate([keys(total), keys(total[:, -LAST * BITS :], LAST, comb(KEYED, CHOSEN))], axis=1)


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Bits in which the fingerprint differs from each of the others."""
    return np.bitwise_count(one ^ many).sum(-1)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in B.slices(batch, "text"):
            total = sums(B.strings(part.column(1)))
            there = total.any(1)
            yield pa.record_batch([part.column(0), part.column(2), pa.array([t.tobytes() if ok else None for t, ok in zip(packed(total), there)], pa.binary()), pa.array([t.tobytes() if ok else None for t, ok in zip(shares(total), there)], pa.binary())], ["id", "text_hash", "print", "total"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for lo in range(0, len(ids), 2048):
            part = batch.slice(lo, 2048)
            total = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int8).reshape(part.num_rows, SEGMENTS * BITS)
            k = all_keys(total)
            yield pa.record_batch([pa.array(k.ravel()), pa.array(np.repeat(ids[lo : lo + 2048], k.shape[1]))], ["key", "id"])


def _shared(chunk: int, most: int = PARTITION_ROWS):
    """Of a partition that holds all rows of its keys: those whose key has more than one document, with the number of their chunk.

    Rows are held until their keys can be told apart; whenever ``most`` are held, those of hot keys, of which a chunk is
    there, go. What stays is what keys of fewer documents have, of which a partition has a bounded number.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: dict[int, int] = {}  # rows of hot keys that have gone
        held: list[tuple[np.ndarray, np.ndarray]] = []
        limit = n = 0

        def sent(key: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
            """Which of the rows, sorted by key, stay, and the others: those of keys that have gone, or have at least so many."""
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(at, len(key)))
            first = np.array([gone.get(k, 0) for k in key[at].tolist()]) if gone else np.zeros(len(at), np.int64)
            some = (size >= least) | (first > 0)
            if least > 1:
                gone.update(zip(key[at][size >= chunk].tolist(), (first + size)[size >= chunk].tolist()))
                gone.update(zip(key[at][first > 0].tolist(), (first + size)[first > 0].tolist()))
            go = np.repeat(some, size)
            number = ((np.arange(len(key)) - np.repeat(at - first, size))[go] // chunk).astype(np.int32)
            key, ids = key[go], ids[go]
            step = 1 << 17
            return ~go, (pa.record_batch([pa.array(x[lo : lo + step]) for x in (key, number, ids)], ["key", "chunk", "id"]) for lo in range(0, len(key), step))

        def whole() -> tuple[np.ndarray, np.ndarray]:
            key, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key, kind="stable")
            return key[order], ids[order]

        limit = most * 2
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            n += b.num_rows
            if n > limit:
                key, ids = whole()
                stay, rows = sent(key, ids, chunk)
                yield from rows
                held.append((key[stay], ids[stay]))
                n = len(held[0][0])
                limit = max(most * 2, 2 * n)
        if held:
            key, ids = whole()
            if len(key):
                yield from sent(key, ids, 2)[1]

    return of


def links(ids: np.ndarray, prints: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that tie each connected component of documents within ``limit`` bits together.

    It walks a component from one member, each step against what no component holds yet, so that
    a bucket of n copies costs about n comparisons and gives n - 1 pairs.
    """
    left = np.arange(len(ids))
    a, b = [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = apart(prints[at], prints[left]) <= limit
            found = left[near]
            left = left[~near]
            todo.extend(found)
            a.append(np.full(len(found), ids[at]))
            b.append(ids[found])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), _WORDS)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) in each chunk, of rows (key, chunk, id, print) sorted by key and chunk; a chunk may cross batches.

    Rows with a key, and no link, name the keys of more than one chunk.
    """
    rest: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        key, chunk = t.column(0).to_numpy(), t.column(1).to_numpy()
        return np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1

    def of(t: pa.Table) -> pa.RecordBatch:
        ids, prints = t.column(2).to_numpy(), _unpacked(t.column(3))
        at = np.concatenate([[0], cuts(t), [len(ids)]])
        size = np.diff(at)
        two = at[:-1][size == 2]
        near = apart(prints[two], prints[two + 1]) <= MAX_BITS
        found = [(ids[two[near]], ids[two[near] + 1])]
        found += [links(ids[i : i + n], prints[i : i + n]) for i, n in zip(at[:-1][size > 2], size[size > 2])]
        a, b = (np.concatenate(x) for x in zip(*found))
        pairs = _pairs(a, b)
        hot = np.unique(t.column(0).to_numpy()[t.column(1).to_numpy() > 0])
        none = lambda k: pa.nulls(k, pa.int64())
        both = [pa.concat_arrays(x) for x in ((pairs.column(0), none(len(hot))), (pairs.column(1), none(len(hot))), (none(pairs.num_rows), pa.array(hot)))]
        return pa.record_batch(both, ["a", "b", "key"])

    for batch in batches:
        rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        if rest.num_rows < 1 << 15:
            continue
        at = cuts(rest)
        if len(at):
            yield of(rest.slice(0, int(at[-1])))
            rest = rest.slice(int(at[-1]))
    if rest is not None and rest.num_rows:
        yield of(rest)


def _across(t: pa.Table) -> pa.Table:
    """Links between documents outside of their key's largest component (``out``) and those of other components in a chunk."""
    out = t["out"].to_numpy()
    some, chunk = t.filter(out), t.filter(~out)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if some.num_rows and chunk.num_rows:
        ids, roots, prints = chunk["id"].to_numpy(), chunk["root"].to_numpy(), _unpacked(chunk["print"])
        for i, root, own in zip(some["id"].to_numpy(), some["root"].to_numpy(), _unpacked(some["print"])):
            near = np.flatnonzero((apart(own, prints) <= MAX_BITS) & (roots != root))
            near = near[np.unique(roots[near], return_index=True)[1]]  # one of each component is enough
            a.append(np.full(len(near), i))
            b.append(ids[near])
    return pa.Table.from_batches([_pairs(np.concatenate(a), np.concatenate(b))])


def _rest_of_hot_keys(buckets: DataFrame, hot: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that chunks of one key have with one another, as far as they tie components together."""
    rows = buckets.join(hot, "key").join(roots, F.col("id") == F.col("node"), "left").select("key", "chunk", "id", "print", F.coalesce("root", "id").alias("root"))
    rows = cut(rows)
    largest = rows.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    out = rows.join(largest, "key").where("root <> largest").withColumnRenamed("chunk", "part")
    every = out.join(rows.select("key", "chunk").distinct(), "key").select("key", "chunk", "part", "id", "print", "root")
    every = cut(every.withColumn("out", F.lit(True)))
    chunks = rows.join(every.select("key", "chunk", "part").distinct(), ["key", "chunk"]).withColumn("out", F.lit(False))
    return every.unionByName(chunks).groupBy("key", "chunk", "part").applyInArrow(_across, "a long, b long")


def groups(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, print, root) of every document with a fingerprint; those of one group have one root.

    A document is a distinct pair of doc_id and text; ``text_hash`` is the text's xxhash64. See ``duplicates``.
    """
    id_, text = q("doc_id"), q("text")
    own = docs.select(id_.cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).where("id is not null")
    prints = own.mapInArrow(_fingerprints, "id long, text_hash long, print binary, total binary")
    prints = cut(prints.where("print is not null"))
    # Equal fingerprints are joined by their value; only one of each goes on to the keys, under a number of its own.
    tops = cut(prints.groupBy("print").agg(F.min("total").alias("total")).withColumn("node", F.monotonically_increasing_id()))
    # Partitions follow the rows where the session's number is too low.
    rows = tops.count() * (comb(KEYED, CHOSEN) + comb(LAST, CHOSEN)) * NEAREST**CHOSEN
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    keyed = tops.select("node", "total").mapInArrow(_keys, "key long, id long").repartition(parts, "key")
    shared = keyed.mapInArrow(_shared(chunk), "key long, chunk int, id long")
    buckets = shared.join(tops.select(F.col("node").alias("id"), "print"), "id").select("key", "chunk", "id", "print")
    found = cut(buckets.repartition("key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(_verified, "a long, b long, key long").distinct())
    pairs, hot = found.where("key is null").select("a", "b"), found.where("key is not null").select("key").distinct()
    roots = components(pairs)
    if not hot.isEmpty():
        more = _rest_of_hot_keys(buckets, hot, roots)
        roots = components(cut(pairs.unionByName(more).distinct()))
    tops = tops.select("print", "node").withColumnRenamed("node", "top").join(roots, F.col("top") == F.col("node"), "left").select("print", F.coalesce("root", "top").alias("root"))
    return prints.select("id", "text_hash", "print").distinct().join(tops, "print").select(F.col("id").alias("doc_id"), "text_hash", "print", "root")


def _judged(docs: DataFrame) -> DataFrame:
    """Every member of a group of two or more: (doc_id, text_hash, kept_doc_id, kept_hash, bits, group_size)."""
    member = groups(docs)
    first = F.min(F.struct("doc_id", "text_hash", "print")).alias("kept")
    held = member.groupBy("root").agg(first, F.count("*").alias("group_size")).where("group_size > 1")
    got = member.join(held, "root")
    return got.select("doc_id", "text_hash", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.text_hash").alias("kept_hash"), _bits(F.col("print"), F.col("kept.print")).alias("bits"), "group_size")


def duplicates(docs: DataFrame) -> DataFrame:
    """Each document that goes, with the one of its group that stays: (doc_id, kept_doc_id, bits, group_size).

    ``bits`` is how far the two fingerprints are apart, ``group_size`` the distinct documents in
    the group. Documents without a duplicate aren't in the result.

    A document is a distinct pair of doc_id and text: identical rows are one, and a doc_id that has several texts is as many
    documents, each compared for itself; the kept one may then have the same doc_id. A null doc_id names no document: such
    rows take no part. Null or empty texts and those without
    a word have no fingerprint and aren't duplicates of anything. Texts are taken whole, whatever
    their length. An empty table gives no rows; other columns are not looked at.
    """
    return _judged(docs).where("doc_id <> kept_doc_id or text_hash <> kept_hash").select("doc_id", "kept_doc_id", "bits", "group_size")


def _bits(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints held as bytes, without Python."""
    word = lambda c, i: F.conv(F.substring(F.hex(c), 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(_WORDS)), F.lit(0)).cast("int")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without those that ``duplicates`` lists: one document of each group stays.

    All columns are kept. Rows with a null doc_id or no fingerprint stay, but of identical ones with a doc_id and
    a text (whatever their other columns) one stays. A doc_id that has several texts keeps those that aren't duplicates.
    """
    gone, hash_, nth = fresh(docs, "gone", "gone_hash", "nth")
    listed = _judged(docs).where("doc_id <> kept_doc_id or text_hash <> kept_hash").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(hash_))
    kept = docs.join(listed, (q("doc_id").cast("long") == q(gone)) & (F.xxhash64(q("text")) == q(hash_)), "left_anti")
    ids = docs.select(q("doc_id").alias("id")).where("id is not null")
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return kept
    # Only where some doc_id is repeated.
    rest = [q(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    order = Window.partitionBy(q("doc_id"), F.xxhash64(q("text")), q("text").isNull()).orderBy(F.xxhash64(*rest))
    return kept.withColumn(nth, F.row_number().over(order)).where(q("doc_id").isNull() | (q(nth) == 1)).drop(nth)
