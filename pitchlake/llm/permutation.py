"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``POSTED`` nearest pivots of ``PIVOTS`` (Chavez, Figueroa and Navarro, 2008), and
posted with its place in each of them in these pivots' inverted files (Amato and Savino, 2008). A query reads the
files of its own ``PROBED`` nearest pivots and ranks the vectors that it meets there by the footrule distance: the sum
over these pivots of how far apart the places are, a pivot that isn't among a vector's nearest having place
``POSTED``. The nearest ``RERANKED`` of each shard, with all that tie with the last, are reranked by their cosine.

Shards are of bounded size, and so are the blocks of queries that are sent to all of them: nothing is shuffled
but the best of each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .shared import cut

K = 10
#: Queries are the rows whose id is divisible by this.
EVERY = 50
PIVOTS = 512
#: Nearest pivots in whose files a vector is posted, and whose files a query reads.
POSTED = 128
PROBED = 32
#: Share of a shard's vectors, the nearest by footrule, that are reranked; at least LEAST_RERANKED of them.
RERANKED = 0.12
LEAST_RERANKED = 100
SHARD_ROWS = 16384
#: A small table is cut into so many shards all the same, for parallelism.
LEAST_SHARDS = 6
SEED = 9


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    size = V.length(x)[:, None]
    return x / np.where(size > 0, size, 1)


def orders(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first; ties (to six decimals) go to the lower number."""
    near = np.round(x @ pivots.T, 6)
    return np.argsort(-near, axis=1, kind="stable")[:, :posted].astype(np.uint16)


@dataclass
class Files:
    """Inverted files one after the other: that of pivot p is ``start[p]`` to ``start[p + 1]`` of vectors and places."""

    start: np.ndarray
    vector: np.ndarray
    place: np.ndarray


def inverted(order: np.ndarray, pivots: int) -> Files:
    n, posted = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=pivots))])
    return Files(start, (by_pivot // posted).astype(np.int32), (by_pivot % posted).astype(np.int16))


def footrule(files: Files, n: int, order: np.ndarray, posted: int) -> np.ndarray:
    """Footrule distance over the pivots of ``order`` (those that the query probes) to each of the n vectors of the files."""
    place = np.arange(len(order))
    lo = files.start[order]
    size = files.start[order.astype(np.int64) + 1] - lo
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) + np.repeat(lo - ends + size, size)
    mine = np.repeat(place.astype(np.int16), size)
    # A vector that isn't in a pivot's file is posted - place away; each entry says how much nearer it is.
    nearer = posted - mine - np.abs(files.place[at] - mine)
    return int((posted - place).sum()) - np.bincount(files.vector[at], nearer, n).astype(np.int64)


def search(x: np.ndarray, ids: np.ndarray, files: Files, queries: np.ndarray, own: np.ndarray, order: np.ndarray, posted: int, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores (minus infinity: none) and ids of the k best candidates of each query in one shard."""
    score, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1, np.int64)
    take = min(len(x), max(LEAST_RERANKED, k + 1, int(np.ceil(share * len(x)))))
    for r in range(len(queries)):
        d = footrule(files, len(x), order[r], posted)
        here = np.flatnonzero(d <= np.partition(d, take - 1)[take - 1])
        here = here[ids[here] != own[r]]
        s = (x[here] * queries[r]).sum(1)[None]
        pick = V.best(s, ids[here][None], k)[0]
        score[r, : len(pick)], found[r, : len(pick)] = s[0, pick], ids[here][pick]
    return score, found


def neighbors(points: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", every: int = 1, pivots: int = PIVOTS, posted: int = POSTED, probed: int = PROBED, share: float = RERANKED, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): about the k other vectors of greatest cosine with each query.

    Queries are the rows whose id is divisible by ``every``; each searches every shard, and every row is indexed. Ties go
    to the lower id; where there are fewer than k others, all are given. The cosine with a zero vector is 0. What counts
    as a vector, and repeated or null ids, are as ``vectors.clean`` says. A table of fewer vectors than
    ``pivots`` has each of them as a pivot. Other columns aren't looked at; an empty table, or one vector, gives no rows.
    """
    vecs, width = V.clean(points, key, vector)
    chosen = normal(V.sample(vecs, pivots, SEED))
    if len(chosen) < 2:
        return V.nothing(points, key)
    posted = min(posted, len(chosen))
    n = vecs.count()
    shards = max(-(-n // shard_rows), min(LEAST_SHARDS, n // LEAST_RERANKED), 1)

    def packed(t: pa.Table) -> pa.Table:
        x = normal(V.matrix(t["v"], width))
        return pa.table([V.blob(a) for a in (t["id"].to_numpy(), x, orders(x, chosen, posted))], names=["ids", "x", "orders"])

    sharded = vecs.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(shards)))
    index = cut(sharded.groupBy("shard").applyInArrow(packed, "ids binary, x binary, orders binary"))

    def block(asked: np.ndarray, queries: np.ndarray) -> DataFrame:
        queries = normal(queries)
        order = orders(queries, chosen, min(probed, posted))

        def run(batches):
            score = found = None
            for b in batches:
                for r in range(b.num_rows):
                    x, ids = V.unblob(b.column("x")[r], np.float64, -1, width), V.unblob(b.column("ids")[r], np.int64)
                    files = inverted(V.unblob(b.column("orders")[r], np.uint16, -1, posted), len(chosen))
                    s, f = search(x, ids, files, queries, asked, order, posted, k, share)
                    score, found = (s, f) if score is None else V.merged(score, found, s, f)
            if score is not None:
                yield pa.record_batch([pa.array(asked), V.near_column(score, found)], ["id", "near"])

        return cut(index.mapInArrow(run, f"id long, near {V.NEAR}"))

    found = None
    for asked, queries in V.query_blocks(vecs, width, every):
        got = block(asked, queries)
        found = got if found is None else found.unionByName(got)
    return V.nothing(points, key) if found is None else V.ranked(found, k, key)
