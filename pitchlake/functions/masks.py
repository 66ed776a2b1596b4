"""Run-length masks: arrays of (start, len) over pixels numbered row by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<start:int,len:int>>"
#: Pairs of runs that are compared at once.
PAIRS = 1 << 20


def mask_area(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda n, r: n + r["len"])


def box_to_mask(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """Pixels of a box with inclusive corners, cut to whole numbers and to the frame: a run for each row."""
    left, top = F.greatest(F.lit(0), x1.cast("int")), F.greatest(F.lit(0), y1.cast("int"))
    right, low = F.least(F.lit(width - 1), x2.cast("int")), F.least(F.lit(height - 1), y2.cast("int"))
    # Compiled functions of arrays; a lambda is interpreted for each row of pixels.
    starts = F.sequence(top * width + left, F.greatest(top, low) * width + left, F.lit(width))
    run = F.arrays_zip(starts.alias("start"), F.array_repeat(right - left + 1, F.greatest(F.lit(0), low - top + 1)).alias("len"))
    return F.when((right >= left) & (low >= top), run.cast(RUNS)).otherwise(F.array().cast(RUNS))


def mask_to_box(mask: Column, width: int) -> Column:
    """(x1, y1, x2, y2) of the set pixels, corners included; null for an empty mask. Runs don't wrap rows."""
    x = F.transform(mask, lambda r: r["start"] % width)
    right = F.transform(mask, lambda r: (r["start"] + r["len"] - 1) % width)
    y = F.transform(mask, lambda r: F.floor(r["start"] / width))
    got = F.struct(F.array_min(x).cast("double").alias("x1"), F.array_min(y).cast("double").alias("y1"), F.array_max(right).cast("double").alias("x2"), F.array_max(y).cast("double").alias("y2"))
    return F.when(F.size(mask) > 0, got)


def shared_pixels(pair_a: np.ndarray, a: tuple[np.ndarray, np.ndarray], pair_b: np.ndarray, b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Pixels that the masks of each of ``n`` pairs share, from the runs (start, len) of all of them and the pairs these are of.

    A run of a has as many pixels of b as there are before its end, less those before its start. Runs of a mask don't overlap.
    """
    (pair_a, start_a, size_a), (pair_b, start_b, size_b) = ((pair[size > 0], start[size > 0].astype(np.int64), size[size > 0].astype(np.int64)) for pair, (start, size) in ((pair_a, a), (pair_b, b)))
    if not len(pair_a) or not len(pair_b):
        return np.zeros(n, np.int64)
    least = min(start_a.min(), start_b.min())
    wide = max((start_a + size_a).max(), (start_b + size_b).max()) - least + 1
    lo, at = pair_a * wide + start_a - least, pair_b * wide + start_b - least
    if (at[1:] < at[:-1]).any():
        order = np.argsort(at, kind="stable")
        at, size_b = at[order], size_b[order]
    before = np.cumsum(size_b) - size_b

    def up_to(x: np.ndarray) -> np.ndarray:
        k = np.maximum(np.searchsorted(at, x, side="right") - 1, 0)
        return before[k] + np.clip(x - at[k], 0, size_b[k])

    # Sums of whole numbers, which are exact as floats up to 2**53.
    return np.bincount(pair_a, up_to(lo + size_a) - up_to(lo), n).astype(np.int64)


def _runs_of(masks: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The mask that each run is of, and (start, len) of the runs."""
    runs = masks.flatten()
    held = np.repeat(np.arange(len(masks)), pc.fill_null(pc.list_value_length(masks), 0).to_numpy())
    return held, (runs.field("start").to_numpy(), runs.field("len").to_numpy())


def mask_intersection(a: Column, b: Column) -> Column:
    """Pixels that two masks share, over Arrow, a batch at once. Runs of a mask don't overlap.

    It counts as not deterministic, so that a condition on it isn't pushed below and it isn't computed twice.
    """

    @F.arrow_udf("int")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        n = shared_pixels(*_runs_of(a), *_runs_of(b), len(a))
        return pa.array(n.astype(np.int32), mask=pc.or_(a.is_null(), b.is_null()).to_numpy(False))

    return of.asNondeterministic()(a, b)


def mask_overlap(a: Column, b: Column, metric: str = "ios") -> Column:
    """The part that two masks share of the smaller one (``ios``) or of both (``iou``), over Arrow as ``mask_intersection``."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        (pair_a, runs_a), (pair_b, runs_b) = _runs_of(a), _runs_of(b)
        part = shared_pixels(pair_a, runs_a, pair_b, runs_b, len(a))
        na, nb = np.bincount(pair_a, runs_a[1], len(a)), np.bincount(pair_b, runs_b[1], len(a))
        whole = np.minimum(na, nb) if metric == "ios" else na + nb - part
        # A null's share of a mask of some pixels is null, as expressions of columns have it.
        none = pc.or_(a.is_null(), b.is_null()).to_numpy(False) & (na + nb > 0) & (metric == "ios")
        return pa.array(np.divide(part, whole, out=np.zeros(len(a)), where=whole > 0), mask=none)

    return of.asNondeterministic()(a, b)


def _row_runs(mask: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(mask, y, first x, last x) of the longest runs within rows, in order of mask and place."""
    mask, start, size = (a[size > 0] for a in (mask, start.astype(np.int64), size))
    lo, hi = start, start + size - 1
    y, low = lo // width, hi // width
    if (y != low).any():
        rows = low - y + 1
        again = lambda a: np.repeat(a, rows)
        y = again(y) + np.arange(rows.sum()) - again(np.cumsum(rows) - rows)
        lo, hi, mask = np.maximum(again(lo), y * width), np.minimum(again(hi), y * width + width - 1), again(mask)
    if ((mask[1:] < mask[:-1]) | ((mask[1:] == mask[:-1]) & (lo[1:] < lo[:-1]))).any():
        order = np.lexsort((lo, mask))
        mask, y, lo, hi = mask[order], y[order], lo[order], hi[order]
    if not len(lo):
        return mask, y, lo, hi
    far = mask * (hi.max() + 2)  # masks one after the other, so that the greatest end so far never reaches into the next
    hi = np.maximum.accumulate(hi + far) - far
    new = np.append(True, (lo[1:] > hi[:-1] + 1) | (y[1:] != y[:-1]) | (mask[1:] != mask[:-1]))
    if not new.all():
        new = np.flatnonzero(new)
        mask, y, lo, hi = mask[new], y[new], lo[new], np.maximum.reduceat(hi, new)
    return mask, y, lo - y * width, hi - y * width


def _parts(mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int) -> np.ndarray:
    """Each run's connected part, by the number of the part's first run; diagonal neighbours are connected.

    In a mask with one run a row only runs that follow one another can touch; the others' parts are searched for.
    """
    same = mask[1:] == mask[:-1]
    linked = np.append(False, same & (y[1:] == y[:-1] + 1) & (x0[1:] <= x1[:-1] + 1) & (x1[1:] >= x0[:-1] - 1))
    label = np.maximum.accumulate(np.where(linked, 0, np.arange(len(y))))
    several = same & (y[1:] == y[:-1])
    if several.any():
        held = np.zeros(mask[-1] + 1, bool)
        held[mask[1:][several]] = True
        at = np.flatnonzero(held[mask])
        label[at] = at[_searched_parts(mask[at], y[at], x0[at], x1[at], width)]
    return label


def _searched_parts(mask: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int) -> np.ndarray:
    row = mask * (y.max(initial=0) + 2) + y
    first = np.searchsorted(row * width + x1, (row + 1) * width + np.maximum(x0 - 1, 0))
    end = np.searchsorted(row * width + x0, (row + 1) * width + np.minimum(x1 + 1, width - 1), side="right")
    a, b = _ranges(first, end)
    label = np.arange(len(y))
    while True:  # the lesser label of both ends, then that label's own, until all agree
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, n) for each n of first[k] up to end[k]."""
    size = np.maximum(end - first, 0)
    k = np.repeat(np.arange(len(first)), size)
    return k, np.arange(len(k)) + np.repeat(first - (np.cumsum(size) - size), size)


def near_segments(mask: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, relative_distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, start, size) of the runs that stay, of many masks at once.

    Of each mask stay the largest connected part (of equally large ones the first) and each part whose edge is within that
    share of the mask's diagonal of it.
    """
    mask, y, x0, x1 = _row_runs(mask, start, size, width)
    if not len(mask):
        return mask, y, x0
    part = _parts(mask, y, x0, x1, width)
    head = np.flatnonzero(part == np.arange(len(part)))
    pixels = np.bincount(part, x1 - x0 + 1, len(part))[head]
    group = np.append(0, np.cumsum(mask[head][1:] != mask[head][:-1]))
    most = np.flatnonzero(pixels == np.maximum.reduceat(pixels, np.flatnonzero(np.append(True, group[1:] != group[:-1])))[group])
    main = head[most[np.append(True, group[most][1:] != group[most][:-1])]]
    begins = np.flatnonzero(np.append(True, mask[1:] != mask[:-1]))
    runs = np.diff(np.append(begins, len(mask)))
    kept = part == np.repeat(main, runs)
    if not kept.all():
        kept |= _near(np.repeat(np.arange(len(begins)), runs), begins, y, x0, x1, kept, relative_distance, part)[part]
    return mask[kept], (y * width + x0)[kept], (x1 - x0 + 1)[kept]


def _near(held: np.ndarray, begins: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, kept: np.ndarray, relative_distance: float, part: np.ndarray) -> np.ndarray:
    """By part, whether one of its runs is near a run that is kept; only runs of rows near enough are compared, about ``PAIRS`` at once."""
    span = lambda a, b: np.maximum.reduceat(b, begins) - np.minimum.reduceat(a, begins) + 1
    limit = relative_distance * np.hypot(span(x0, x1), span(y, y))
    own, rest = np.flatnonzero(kept), np.flatnonzero(~kept)
    high = y.max() + 1
    reach, row = np.minimum(np.floor(limit), high).astype(np.int64)[held[rest]], held[own] * high + y[own]
    first = np.searchsorted(row, held[rest] * high + np.maximum(y[rest] - reach, 0))
    end = np.searchsorted(row, held[rest] * high + np.minimum(y[rest] + reach, high - 1), side="right")
    found = np.zeros(len(part), bool)
    total = np.cumsum(np.maximum(end - first, 0))
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)), [0, len(rest)]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        k, n = _ranges(first[lo:hi], end[lo:hi])
        a, b = rest[lo:hi][k], own[n]
        gap = np.maximum(0, np.maximum(x0[a] - x1[b], x0[b] - x1[a]))
        found[part[a[np.hypot(gap, y[a] - y[b]) <= limit[held[a]]]]] = True
    return found


def keep_near_segments(runs: list, width: int, relative_distance: float) -> list:
    """``near_segments`` of one mask, as a list of runs."""
    start, size = (np.array([r[f] for r in runs], np.int64) for f in ("start", "len"))
    _, start, size = near_segments(np.zeros(len(runs), np.int64), start, size, width, relative_distance)
    return [{"start": int(a), "len": int(n)} for a, n in zip(start, size)]


def _near_of(masks: pa.Array, width: int, relative_distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held, runs = _runs_of(masks)
    return near_segments(held, *runs, width, relative_distance)


def filter_segments(width: int, relative_distance: float = 0.03):
    """A column function that drops detached parts of masks; connected parts have no SQL, so it runs over Arrow, a batch at once."""

    @F.arrow_udf(RUNS)
    def of(masks: pa.Array) -> pa.Array:
        mask, start, size = _near_of(masks, width, relative_distance)
        offsets = np.append(0, np.cumsum(np.bincount(mask, minlength=len(masks)))).astype(np.int32)
        kept = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["start", "len"])
        return pa.ListArray.from_arrays(pa.array(offsets), kept, mask=masks.is_null())

    return of


def near_area(width: int, relative_distance: float = 0.03):
    """``mask_area`` of what ``filter_segments`` leaves: only a number for each mask comes back."""

    @F.arrow_udf("int")
    def of(masks: pa.Array) -> pa.Array:
        mask, _, size = _near_of(masks, width, relative_distance)
        return pa.array(np.bincount(mask, size, len(masks)).astype(np.int32), mask=masks.is_null().to_numpy(False))

    return of
