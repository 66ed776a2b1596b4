"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VNODES`` points on a ring of hashes; a key goes to the owner of the first point clockwise
of its own hash, unless that shard is full, and then on clockwise. No shard holds more than ``1 + SLACK``
times the mean (Mirrokni, Thorup and Zadimoghaddam, 2018).

Which keys a full shard keeps must not depend on the order of arrival. Each key has a priority, one of
``2 ** BITS`` levels taken from a second hash; a shard keeps the lower levels. That is deferred
acceptance: the keys of one arc all prefer the same shards in the same order, so the outcome is
determined by one cutoff for each shard, and these follow from counts by arc and level, of which there
are a fixed number whatever the table. Rows are then placed by looking up the cutoffs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import mix
from .shared import fresh, q

SHARDS = 64
VNODES = 32
SLACK = 0.1
BITS = 8
MOST_BITS = 12


@dataclass
class Ring:
    """Points in order, and for each the first distinct shards met from there on, clockwise: as many as were asked for."""

    names: tuple[str, ...]
    points: np.ndarray
    owners: np.ndarray
    walk: np.ndarray  # arc x depth

    @staticmethod
    def of(names: tuple[str, ...], vnodes: int = VNODES, depth: int = 8) -> Ring:
        at = sorted((int.from_bytes(hashlib.md5(f"{n}#{v}".encode()).digest()[:8], "big"), k) for k, n in enumerate(names) for v in range(vnodes))
        points = np.array([p for p, _ in at], np.uint64)
        owners = np.array([k for _, k in at], np.int64)
        ring = Ring(names, points, owners, np.zeros((len(at), 0), np.int32))
        ring.deepen(min(depth, len(names)))
        return ring

    def deepen(self, depth: int) -> None:
        self.walk = np.empty((len(self.points), depth), np.int32)
        last: list[int] = list(dict.fromkeys(self.owners.tolist()))  # from the first point on
        for arc in range(len(self.points) - 1, -1, -1):
            last.remove(int(self.owners[arc]))
            last.insert(0, int(self.owners[arc]))
            self.walk[arc] = last[:depth]

    def met(self, arc: np.ndarray, step: np.ndarray) -> np.ndarray:
        """The shard that each walk is at after so many steps."""
        most = int(step.max(initial=0)) + 1
        if most > self.walk.shape[1]:
            self.deepen(min(len(self.names), 2 * most))
        return self.walk[arc, step]

    def arcs(self, h: np.ndarray) -> np.ndarray:
        """The number of the first point at or after each hash; past the last it is the first."""
        return np.searchsorted(self.points, h) % len(self.points)


def place(ring: Ring, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Arc and priority level of keys, given their 64-bit hashes."""
    h = h.view(np.uint64)
    level = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)
    return ring.arcs(mix(h)), level


def cutoffs(ring: Ring, arc: np.ndarray, level: np.ndarray, count: np.ndarray, capacity: int, bits: int) -> np.ndarray | None:
    """For each shard, the level below which it keeps keys; None where some keys find no shard.

    Groups of one arc and level move as one. Each round every group asks the first shard of its walk that
    hasn't refused its level; a shard refuses the highest levels, as few as bring it within ``capacity``.
    Cutoffs only fall, so the rounds end.
    """
    levels = 1 << bits
    cut_at = np.full(len(ring.names), levels)
    step = np.zeros(len(arc), np.int64)
    while True:
        shard = ring.met(arc, step).astype(np.int64)
        load = np.bincount(shard * levels + level, count, len(cut_at) * levels).reshape(-1, levels).cumsum(1)
        over = load > capacity
        now = np.where(over.any(1), over.argmax(1), levels)
        if (now >= cut_at).all():
            return cut_at
        cut_at = np.minimum(cut_at, now)
        while (out := level >= cut_at[ring.met(arc, step)]).any():
            step[out] += 1
            if step.max() == len(ring.names):
                return None


def shards_of(ring: Ring, cut_at: np.ndarray, arc: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each key, and how many full shards it passed."""
    step = np.zeros(len(arc), np.int64)
    out = level >= cut_at[ring.met(arc, step)]
    while out.any():
        step[out] += 1
        out[out] = level[out] >= cut_at[ring.met(arc[out], step[out])]
    return ring.met(arc, step), step


def _hash(key: str) -> Column:
    return F.xxhash64(F.coalesce(q(key).cast("string"), F.lit("\0null")))


def shard(docs: DataFrame, key: str = "doc_id", shards: int | tuple[str, ...] = SHARDS, vnodes: int = VNODES, slack: float = SLACK) -> DataFrame:
    """All rows and columns with ``shard`` (its name) and ``hops``, the full shards that the key passed.

    Loads count distinct keys: rows that repeat a key go where it goes. No shard gets more than
    ``ceil((1 + slack) * keys / shards)`` keys. A null key is a key of its own. Texts aren't looked at, whatever their
    length. An empty table stays empty. Columns named ``shard`` or ``hops`` are replaced. Keys of equal
    hash are one key to the ring. Adding or removing a shard moves the keys that it gains or held, and those
    that the changed capacities push on.
    """
    names = tuple(f"shard-{k:04d}" for k in range(shards)) if isinstance(shards, int) else tuple(shards)
    ring = Ring.of(names, vnodes)
    keep = [c for c in docs.columns if c.lower() not in ("shard", "hops")]
    keys = docs.select(_hash(key).alias("h")).distinct()
    bits = BITS
    while True:
        level_bits = bits

        def counted(batches, bits=level_bits):
            held: np.ndarray | None = None
            for b in batches:
                arc, level = place(ring, b.column(0).to_numpy(), bits)
                n = np.bincount(arc << bits | level, minlength=len(ring.points) << bits)
                held = n if held is None else held + n
            if held is not None:
                at = np.flatnonzero(held)
                yield pa.record_batch([pa.array(at), pa.array(held[at])], ["cell", "n"])

        cells = keys.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
        cell, n = cells["cell"].to_numpy(), cells["n"].to_numpy()
        capacity = int(np.ceil((1 + slack) * n.sum() / len(names)))
        found = cutoffs(ring, cell >> bits, cell & ((1 << bits) - 1), n, capacity, bits)
        if found is not None:
            break
        if bits >= MOST_BITS:
            raise ValueError(f"{len(names)} shards of {capacity} keys can't take the keys: give more slack")
        bits += 2  # finer levels waste less room

    @F.arrow_udf("struct<shard string, hops int>")
    def assigned(h: pa.Array) -> pa.Array:
        where, hops = shards_of(ring, found, *place(ring, h.to_numpy(zero_copy_only=False), bits))
        return pa.StructArray.from_arrays([pa.array(names).take(pa.array(where)), pa.array(hops.astype(np.int32))], names=["shard", "hops"])

    (placed,) = fresh(docs, "placed")
    got = docs.select([q(c) for c in keep]).withColumn(placed, assigned(_hash(key)))
    return got.select([q(c) for c in keep] + [q(placed)["shard"].alias("shard"), q(placed)["hops"].alias("hops")])
