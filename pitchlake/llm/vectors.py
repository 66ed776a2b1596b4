"""What the vector searches share: clean vectors, blocks of queries, and arrays from Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, q

#: Elements of this size and more would overflow in a product, and count as infinite.
MOST = 1e150
#: Bytes of the queries that are searched for at once, about: what the driver holds and each task is sent.
QUERY_BYTES = 1 << 24


def clean(points: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) with one row for each id, written to the shared folder, and the dimension.

    Rows with a null id, a null vector, an element that is null, not a number, infinite or of size ``MOST`` and more, or
    another length than the most frequent one (the shorter of equally frequent ones) are left out. Of an id's
    vectors the least counts.
    """
    v = q(vector).cast("array<double>")
    got = points.select(q(key).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    got = got.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST))))
    sizes = got.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return cut(got), 0
    got = got.where(F.size("v") == sizes["n"])
    return cut(got.groupBy("id").agg(F.min("v").alias("v"))), int(sizes["n"])


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def length(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; squares of very large or small elements neither overflow nor vanish."""
    most = np.abs(x).max(axis=1, initial=0.0)
    return most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1))


def sample(vecs: DataFrame, rows: int, seed: int) -> np.ndarray:
    """Vectors of the rows with the least hashes; they only place cells and pivots."""
    got = vecs.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).toArrow()
    width = len(got["v"][0]) if got.num_rows else 1
    return matrix(got["v"], width) if got.num_rows else np.zeros((0, 1))


def query_blocks(vecs: DataFrame, width: int, every: int, most: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows whose id is divisible by ``every``, about ``most`` bytes at a time, whatever their number."""
    asked = vecs.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() * 8 * width // most))
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().sort_by("id")
        if got.num_rows:
            yield got["id"].to_numpy(), np.ascontiguousarray(matrix(got["v"], width))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, by falling score, then by id; a score of minus infinity is an empty place."""
    if score.shape[1] > 4 * k:
        # Those below the kth score can't be among them; ties at it all stay.
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        most = int((score >= kth[:, None]).sum(1).max())
        part = np.argpartition(-score, min(most, score.shape[1] - 1), axis=1)[:, : most + 1]
        order = np.lexsort((np.take_along_axis(ids, part, 1), -np.take_along_axis(score, part, 1)), axis=1)[:, :k]
        return np.take_along_axis(part, order, 1)
    return np.lexsort((ids, -score), axis=1)[:, :k]


def merged(score: np.ndarray, found: np.ndarray, more: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of each row's held ones (k of them) and of more."""
    both, who = np.concatenate([score, more], axis=1), np.concatenate([found, names], axis=1)
    pick = best(both, who, score.shape[1])
    score = np.take_along_axis(both, pick, 1)
    return score, np.where(score > -np.inf, np.take_along_axis(who, pick, 1), -1)


def ranked(found: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(key, rank, neighbor_id, score) from rows (id, near: array of (minus, nid)), several for an id."""
    held = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    got = held.select(F.col("id").alias(key), F.posexplode("near").alias("n", "s"))
    return got.select(key, (F.col("n") + 1).cast("int").alias("rank"), F.col("s.nid").alias("neighbor_id"), (-F.col("s.minus") + F.lit(0.0)).alias("score"))


NEAR = "array<struct<minus:double,nid:bigint>>"
_NEAR = pa.list_(pa.struct([("minus", pa.float64()), ("nid", pa.int64())]))


def near_column(score: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Rows of scores and ids as a column of arrays; empty places are left out."""
    there = score > -np.inf
    offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(-score[there] + 0.0), pa.array(ids[there])], names=["minus", "nid"])
    return pa.ListArray.from_arrays(pa.array(offsets), items).cast(_NEAR)


def nothing(points: DataFrame, key: str) -> DataFrame:
    """The result of a search where there is nothing to find."""
    return points.sparkSession.createDataFrame([], f"{key} long, rank int, neighbor_id long, score double")


def blob(a: np.ndarray) -> pa.Array:
    """One row that holds an array's bytes."""
    return pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())


def unblob(value: pa.Scalar, kind: type, *shape: int) -> np.ndarray:
    a = np.frombuffer(value.as_buffer() or b"", kind)
    return a.reshape(shape) if shape else a
