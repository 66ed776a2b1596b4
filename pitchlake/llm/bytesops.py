"""Whole Arrow batches of text as numpy arrays of bytes: words, hashes and counts without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(members: bytes, high: bool = False) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    if high:
        t[128:] = True
    return t


ALNUM = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", high=True)
NOT_SPACE = np.arange(256) > 32
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one array with 64-bit offsets, nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Its bytes, and the n + 1 offsets of its values in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``limit`` bytes; a longer text is a run of its own."""
    column = strings(batch.column(batch.schema.get_field_index(text)))
    ends = buffers(column)[1][1:]
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def runs(member: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest run of member bytes; none crosses from one row to the next."""
    inside = member[data]
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[:-1]
    edge = edge[edge < n]
    begins[edge] = inside[edge]
    edge = offsets[1:]
    edge = edge[edge > 0] - 1
    stops[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run, equal for equal bytes wherever they stand."""
    n = len(data) + 1
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + SLICE_BYTES // 4)
        for k, base in enumerate((_P, _PINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(np.uint64))


def sums_by(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of the values of each run."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[start]
