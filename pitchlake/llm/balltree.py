"""Exact top-k search by inner product: a ball tree in each shard, searched by branch and bound.

No vector of a ball (centre c, radius r) has a greater inner product with q than q.c + |q| r. Nodes are taken in
the order of that bound, and a node is passed over by every query whose kth score so far is above it. Vectors
that lie together share a shard, whose tree is built once and written. A block of queries of bounded size is sent to
all shards, twice: first each query searches the shard that it lies in, then, with the kth score found there, which
prunes from the start, the others. A shard whose ball can't hold anything better is passed over at its root.

Scores are sums in a fixed order, so that equal vectors tie exactly; those of whole blocks by matrix product only say
which pairs to look at, with slack for their rounding.
"""

from __future__ import annotations

import heapq
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
#: Vectors of a shard, at most about twice this. A small table is cut into LEAST_SHARDS all the same, for parallelism.
SHARD_ROWS = 16384
LEAST_SHARDS = 6
#: Vectors that the shards' centres are placed by, at most. It bounds the number of cells; cells of many vectors are cut by hash.
SAMPLE = 8192
LEAF = 128
BLOCK = 256
SEED = 3
#: Added to bounds, relative to |q| (|c| + r): more than rounding can lose.
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes in preorder; ``order`` puts the vectors into the order of the leaves."""

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    right: np.ndarray  # number of the second child; 0: a leaf. The first child follows its parent.


def build(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split by the median along the line between two far apart vectors, down to ``leaf`` vectors or equal ones."""
    order = np.arange(len(x))
    rows: list[list] = []

    def node(lo: int, hi: int) -> None:
        own = x[order[lo:hi]]
        c = own.mean(0)
        far = V.length(own - c)
        n = len(rows)
        rows.append([c, float(far.max(initial=0)), lo, hi, 0])
        if hi - lo <= leaf or far.max() == 0:
            return
        a = own[far.argmax()]
        b = own[V.length(own - a).argmax()]
        along = own @ (a - b)
        mid = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(along, mid)]
        node(lo, lo + mid)
        rows[n][4] = len(rows)
        node(lo + mid, hi)

    if len(x):
        node(0, len(x))
    c, r, lo, hi, right = zip(*rows) if rows else ((), (), (), (), ())
    ints = lambda v: np.array(v, np.int64)
    return Tree(order, np.array(c).reshape(len(rows), -1), np.array(r), ints(lo), ints(hi), ints(right))


def search(x: np.ndarray, ids: np.ndarray, tree: Tree, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Scores (minus infinity: none) and ids of each query's k best vectors with at least the score ``floor``; not itself (``own``).

    ``x`` and ``ids`` are in the order of the tree's leaves.
    """
    m = len(queries)
    score, found = np.full((m, k), -np.inf), np.full((m, k), -1, np.int64)
    if not len(x) or not m:
        return score, found
    length = V.length(queries)
    reach = V.length(tree.center) + tree.radius
    # Queries that are alike go through the tree together.
    leaves = np.flatnonzero(tree.right == 0)
    alike = np.lexsort((np.arange(m), (queries @ tree.center[leaves].T).argmax(1)))
    for lo in range(0, m, block):
        rows = alike[lo : lo + block]
        qs, me, size = queries[rows], own[rows], length[rows]
        low = floor[rows].copy()
        s, f = score[rows], found[rows]
        bound = lambda n, at, qs=qs, size=size: qs[at] @ tree.center[n] + size[at] * (tree.radius[n] + SLACK * reach[n])
        everyone = np.arange(len(rows))
        first = bound(0, everyone)
        todo = [(-float(first.max()), 0, everyone, first)]
        while todo:
            _, n, at, top = heapq.heappop(todo)
            live = top >= low[at]
            if not live.any():
                continue
            at = at[live]
            if tree.right[n]:
                for child in (n + 1, int(tree.right[n])):
                    b = bound(child, at)
                    good = b >= low[at]
                    if good.any():
                        heapq.heappush(todo, (-float(b[good].max()), child, at[good], b[good]))
                continue
            i, j = tree.start[n], tree.end[n]
            near = qs[at] @ x[i:j].T
            near[ids[None, i:j] == me[at, None]] = -np.inf
            a, b = np.nonzero((near > -np.inf) & (near >= (low[at] - SLACK * size[at] * reach[n])[:, None]))
            exact = (qs[at[a]] * x[i + b]).sum(1)
            good = exact >= low[at[a]]
            if not good.any():
                continue
            a, b, exact = a[good], b[good], exact[good]
            mine, a = np.unique(a, return_inverse=True)
            got = np.full((len(mine), j - i), -np.inf)
            got[a, b] = exact
            at = at[mine]
            s[at], f[at] = V.merged(s[at], f[at], got, np.broadcast_to(ids[i:j], got.shape))
            low[at] = np.maximum(low[at], s[at, -1])
        score[rows], found[rows] = s, f
    return score, found


def _centers(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of about n balls that the vectors split into."""
    if len(x) == 0:
        return x
    t = build(x, max(1, -(-len(x) // n)))
    return t.center[t.right == 0]


_INDEX = "ids binary, x binary, center binary, radius binary, start binary, end binary, right binary"


def _packed(t: pa.Table, width: int) -> pa.Table:
    """One row: the shard's vectors in the order of the leaves, and its tree."""
    x, ids = V.matrix(t["v"], width), t["id"].to_numpy()
    tree = build(x)
    held = (ids[tree.order], x[tree.order], tree.center, tree.radius, tree.start, tree.end, tree.right)
    return pa.table([V.blob(a) for a in held], names=["ids", "x", "center", "radius", "start", "end", "right"])


def _shards(batches, width: int):
    for b in batches:
        for r in range(b.num_rows):
            get = lambda name, kind, *shape, b=b, r=r: V.unblob(b.column(name)[r], kind, *shape)
            ints = [get(name, np.int64) for name in ("start", "end", "right")]
            tree = Tree(np.arange(0), get("center", np.float64, -1, width), get("radius", np.float64), *ints)
            yield get("x", np.float64, -1, width), get("ids", np.int64), tree


def top_k(points: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", every: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k other vectors of greatest inner product with each query, exactly.

    Queries are the rows whose id is divisible by ``every``. Ties go to the lower id; where there are fewer than k
    others, all are given. ``score`` is as summed in double precision. What counts as a vector, and repeated or null ids,
    are as ``vectors.clean`` says. Other columns aren't looked at; an empty table, or one vector, gives no rows.
    """
    vecs, width = V.clean(points, key, vector)
    n = vecs.count()
    if n < 2:
        return V.nothing(points, key)
    shards = max(-(-n // shard_rows), min(LEAST_SHARDS, n // LEAF))
    centers = _centers(V.sample(vecs, SAMPLE, SEED), max(1, shards))
    # Compared on the scale of the vectors, so that squares can't overflow.
    scale = max(float(np.abs(centers).max()), 1e-300)
    scaled = centers / scale

    @F.arrow_udf("int")
    def nearest(v: pa.Array) -> pa.Array:
        return pa.array(((scaled**2).sum(1) - 2 * (V.matrix(v, width) / scale) @ scaled.T).argmin(1).astype(np.int32))

    cells = cut(vecs.withColumn("cell", nearest("v")))
    # A cell of many vectors is cut by hash into several shards.
    parts = cells.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(SEED)), "parts").alias("part")
    sharded = cells.join(parts, "cell").select("cell", part, "id", "v")
    index = cut(sharded.groupBy("cell", "part").applyInArrow(lambda t: _packed(t, width), _INDEX))
    found = None
    for ids, queries in V.query_blocks(vecs, width, every):
        pair = _searched(index, ids, queries, k, width)
        found = pair if found is None else found.unionByName(pair)
    return V.nothing(points, key) if found is None else V.ranked(found, k, key)


def _searched(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, width: int) -> DataFrame:
    """(id, near) of a block of queries, several rows for an id."""
    schema = pa.schema([("id", pa.int64()), ("near", V.near_column(np.zeros((0, k)), np.zeros((0, k), np.int64)).type), ("kth", pa.float64())])

    def home(batches):
        for x, names, tree in _shards(batches, width):
            at = np.flatnonzero(np.isin(ids, names))
            s, f = search(x, names, tree, queries[at], ids[at], k, np.full(len(at), -np.inf))
            yield pa.record_batch([pa.array(ids[at]), V.near_column(s, f), pa.array(s[:, -1])], schema=schema)

    own = cut(index.mapInArrow(home, f"id long, near {V.NEAR}, kth double"))
    got = own.select("id", "kth").toArrow().sort_by("id")
    floor = got["kth"].to_numpy()

    def away(batches):
        # The kth score goes on from shard to shard of a task.
        low = floor.copy()
        for x, names, tree in _shards(batches, width):
            at = np.flatnonzero(~np.isin(ids, names))
            s, f = search(x, names, tree, queries[at], ids[at], k, low[at])
            low[at] = np.maximum(low[at], s[:, -1])
            some = s[:, 0] > -np.inf
            yield pa.record_batch([pa.array(ids[at[some]]), V.near_column(s[some], f[some])], schema=pa.schema(list(schema)[:2]))

    far = cut(index.mapInArrow(away, f"id long, near {V.NEAR}"))
    return own.select("id", "near").unionByName(far)


def sql(k: int = K, every: int = EVERY, table: str = "embeddings") -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from {table}),
pairs as (select a.vec_id, b.vec_id as neighbor_id, list_dot_product(a.e, b.e) as s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0),
ranks as (select *, cast(row_number() over (partition by vec_id order by s desc, neighbor_id) as int) as rank from pairs)
select vec_id, rank, neighbor_id, round(s, 6) as score from ranks where rank <= {k}
"""
