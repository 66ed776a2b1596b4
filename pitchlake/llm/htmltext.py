"""Main text of web pages: what the pages of a host have in common is found by a host suffix array and left out.

A page is a stream of tokens: tags by their names, and words. Each task concatenates the streams of its pages, a run of pages at a
time, and builds their suffix array by prefix doubling, tokens mixed with their host: neighbours that have ``LEAST``
tokens and more in common are repeats, and so is whatever longer substring they begin. Every substring of ``LEAST`` tokens
that the run holds is then one entry, with the pages that it is on. All tokens covered by a
substring that is on several pages of the host are boilerplate; the runs between are kept.

Template blocks that are shorter than that, as most footers are, stand between unique text and the end of a page, so that
no substring of ``LEAST`` tokens covers them. They are judged whole: what stands between two block tags with ``FEW``
words at least, and a footer, header, navigation or aside with any words, is boilerplate, too, if it is on other pages of the host.

The sorted runs of all tasks are merged by ranges of the 64-bit fingerprint of an entry's ``LEAST`` tokens with their host, as hosts
may be of any size. Only entries that can be shared are sent. Winnowing sees to that: of the
``GRAM``-token grams of an entry's ``LEAST`` tokens the one with the least hash is its anchor, equal entries have equal
anchors, and few places are anchors. Anchors are merged first, and entries whose anchor is on one
page only are left at home (Schleimer, Wilkerson and Aiken, 2003).

Pages aren't moved: each of the three passes reads them from their source. After a merge, every task is told which of the
fingerprints that it sent are shared, by a file of its own in the shared folder.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import cut, q, shared_folder

#: Tokens of a shared substring, at least.
LEAST = 16
GRAM = 6
#: Distinct pages of the host that it is on, at least.
PAGES = 2
#: Words of a shared block of fewer tokens than ``LEAST``, at least. Shorter paragraphs are alike by chance; elements of the frame count at any size.
FEW = 4

_FRAME = "footer header nav aside".split()

_BLOCK_TAGS = "p br div li ul ol tr td th table h1 h2 h3 h4 h5 h6 article section header footer nav aside main blockquote pre dl dt dd form hr figure body html".split()
_HELD = 4 << 20

_MARK = re.compile(rb"<!--|-->|<(/?)(script|style)(?![a-z0-9-])", re.I)
#: Units (tasks) whose news are in one folder.
_UNITS = 16
_NAME = B._table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-")
_OPENS = B._table(b"/!?abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

_P = np.uint64(0xD6E8FEB86659FD93)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


@dataclass
class Tokens:
    """Tokens of a run of pages: hash, place in ``data``, page number (in order), and whether it is a tag."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    page: np.ndarray
    tag: np.ndarray
    hash: np.ndarray


def without_code(page: bytes) -> bytes:
    """The page without its comments, scripts and styles, in one walk over where they begin and end.

    One that isn't closed is text, so that it doesn't swallow the rest of the page.
    """
    marks = [(m.start(), m.end(), (m[2] or b"").lower(), m[0] == b"-->" or m[1] == b"/") for m in _MARK.finditer(page)]
    if not marks:
        return page
    ends: dict[bytes, list[tuple[int, int]]] = {}
    for start, end, name, closes in marks:
        if closes:
            ends.setdefault(name, []).append((start, end))
    nth = dict.fromkeys(ends, 0)
    out, at = [], 0
    for start, end, name, closes in marks:
        if closes or start < at or name not in ends:
            continue
        # Places of ends are only gone over once: what lies before one opening lies before the next.
        while nth[name] < len(ends[name]) and ends[name][nth[name]][0] < end:
            nth[name] += 1
        if nth[name] == len(ends[name]):
            continue
        stop = ends[name][nth[name]][1]
        if name:
            close = page.find(b">", stop)
            stop = close + 1 if close >= 0 else len(page)
        out += [page[at:start], b" "]
        at = stop
    return b"".join([*out, page[at:]])


def tokens(column: pa.LargeStringArray) -> Tokens:
    """The tokens of each page, without comments, scripts and styles."""
    raw, offsets = B.buffers(column)
    whole = raw.tobytes()
    pages = [without_code(whole[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
    data = np.frombuffer(b"".join(pages), np.uint8)
    offsets = np.cumsum([0] + [len(p) for p in pages])
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if not n:
        return Tokens(data, nothing, nothing, nothing, nothing.astype(bool), nothing.astype(np.uint64))
    opens = np.flatnonzero(data[:-1] == 60)
    opens = opens[_OPENS[data[opens + 1]]]
    stop = np.append(np.flatnonzero(data == 62), n - 1)
    close = stop[np.searchsorted(stop, opens)]
    # A tag ends with its page at the latest; a '<' inside a tag is part of it.
    last = offsets[np.searchsorted(offsets, opens, "right")] - 1
    close = np.minimum(close, last)
    real = np.append(True, opens[1:] > np.maximum.accumulate(close)[:-1]) if len(opens) else np.zeros(0, bool)
    opens, close = opens[real], close[real]
    depth = np.zeros(n + 1, np.int8)
    depth[opens] += 1
    depth[close + 1] -= 1
    in_tag = np.cumsum(depth[:-1], dtype=np.int8) > 0
    text = ~in_tag & (data > 32)
    begins, stops = text.copy(), text.copy()
    begins[1:] &= ~text[:-1]
    stops[:-1] &= ~text[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = text[edge]
    stops[edge - 1] = text[edge - 1]
    ws, we = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    # A tag's token is '<' or '</' and its name.
    other = np.append(np.flatnonzero(~_NAME[data]), n)
    after = opens + 1 + (data[np.minimum(opens + 1, n - 1)] == 47)
    te = np.minimum(other[np.searchsorted(other, after)], close + 1)
    low = data.copy()
    low[in_tag] = B.LOWER[data[in_tag]]
    start = np.concatenate([ws, opens])
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.concatenate([we, te])[order]
    return Tokens(data, start, end, np.searchsorted(offsets, start, "right") - 1, order >= len(ws), B.hashes(low, start, end))


def grams(hashes: np.ndarray, size: int, salt: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of ``size`` tokens, by its first; those that would run over the end are left out."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums, down = _sums(hashes)
    got = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    return B.mix(got if salt is None else got ^ salt[: n - size + 1])


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the hashes by powers, and the inverse powers."""
    n = len(hashes)
    up = np.full(n + 1, _P)
    down = np.full(n + 1, _PINV)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return sums, down


def anchors(gram: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` grams the place of the least (the last of equal ones)."""
    n = len(gram) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    least = gram[:n].copy()
    for k in range(1, window):
        g = gram[k : n + k]
        low = g <= least
        np.copyto(least, g, where=low)
        best[low] = np.flatnonzero(low) + k
    return best


def _of_tags(names: list[str]) -> np.ndarray:
    """Hashes of the opening and the closing tag of each name, in turn."""
    raw = np.frombuffer(b"".join(f"<{t}</{t}".encode() for t in names), np.uint8)
    size = np.array([len(t) + k for t in names for k in (1, 2)])
    end = np.cumsum(size)
    return B.hashes(raw, end - size, end)


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def suffixes(t: Tokens, salt: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of at least ``least`` tokens on their own page, and the fingerprints of these tokens."""
    f = grams(t.hash, least, salt)
    whole = np.flatnonzero(t.page[: len(f)] == t.page[least - 1 :][: len(f)]) if len(f) else np.zeros(0, np.int64)
    return whole, f[whole]


@dataclass
class SuffixArray:
    """Suffixes in order, and how many tokens each has in common with the one before it."""

    order: np.ndarray
    common: np.ndarray


def suffix_array(token: np.ndarray, page: np.ndarray) -> SuffixArray:
    """All suffixes of the pages' streams, one after the other, by prefix doubling; each ends with its page.

    Suffixes that have the same first 2^k tokens have the same rank in round k; only those that tie are sorted again, by the rank of what
    comes 2^k tokens later, until none tie. The common prefix of neighbours is put together from the ranks of the rounds.
    """
    n = len(token)
    order = np.argsort(token, kind="stable")
    at = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(at, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, size)
    end = _ends(page)
    ranks, step = [rank.astype(np.int32)], 1
    tied = np.repeat(size > 1, size)
    while tied.any():
        place = np.flatnonzero(tied)
        own = order[place]
        later = own + step
        # Past the page's end stands the page itself, which is different from all tokens and other pages.
        second = np.where(later < end[own], rank[np.minimum(later, n - 1)], -1 - page[own])
        by = np.lexsort((second, rank[own]))
        own, first, second = own[by], rank[own[by]], second[by]
        order[place] = own
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(own)))
        rank[own] = np.repeat(place[at], size)
        tied[place] = np.repeat(size > 1, size)
        ranks.append(rank.astype(np.int32))
        step *= 2
    common = np.zeros(n, np.int64)
    if n:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            same &= (a + (1 << k) <= end[order[:-1]]) & (b + (1 << k) <= end[order[1:]])
            common[1:] += same * (1 << k)
            a += same * (1 << k)
            b += same * (1 << k)
    return SuffixArray(order, common)


def _ends(page: np.ndarray) -> np.ndarray:
    """Where each token's page ends."""
    last = np.append(np.flatnonzero(page[1:] != page[:-1]) + 1, len(page)) if len(page) else page
    return np.repeat(last, np.diff(np.append(0, last)))


def repeats(t: Tokens, salt: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """One place and its page for each substring of ``least`` tokens and each page of the run that it is on.

    Substrings are the runs of the suffix array whose neighbours have ``least`` tokens and more in common.
    """
    end = _ends(t.page)
    sa = suffix_array(B.mix(t.hash ^ salt), t.page)
    long = end[sa.order] - sa.order >= least
    order, fresh = sa.order[long], (sa.common < least)[long]
    run = np.cumsum(fresh)
    by = np.lexsort((order, t.page[order], run))
    order, run = order[by], run[by]
    first = np.append(True, (run[1:] != run[:-1]) | (t.page[order][1:] != t.page[order][:-1])) if len(order) else np.zeros(0, bool)
    return order[first], t.page[order[first]]


def anchored(t: Tokens, salt: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all grams, and for each place the place of its anchor."""
    g = grams(t.hash, gram, salt)
    return g, anchors(g, least - gram + 1)


def blocks(t: Tokens, salt: np.ndarray, least: int, few: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, number of tokens and fingerprint of each block of fewer than ``least`` tokens.

    A block is a block tag with the tokens up to the next one, of ``few`` words at least, or an element of the frame up to its
    closing tag, of any. It ends with its page. Without ``few`` there are none.
    """
    n = len(t.hash)
    if not n or few is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = np.concatenate([[0], np.cumsum(~t.tag)])
    fresh = np.append(True, t.page[1:] != t.page[:-1])
    first = np.flatnonzero(fresh | (t.tag & within(t.hash, _BREAKS)))
    end = np.append(first[1:], n)
    enough = words[end] - words[first] >= few
    firsts, ends = [first[enough]], [end[enough]]
    page_end = np.append(np.flatnonzero(fresh)[1:], n)
    for opening, closing in _FRAMES:
        first = np.flatnonzero(t.tag & (t.hash == opening))
        close = np.append(np.flatnonzero(t.tag & (t.hash == closing)), n)
        end = np.minimum(close[np.searchsorted(close, first)], page_end[np.searchsorted(page_end, first, "right")])
        enough = words[end] > words[first]
        firsts.append(first[enough])
        ends.append(end[enough])
    first, end = np.concatenate(firsts), np.concatenate(ends)
    short = end - first < least
    first, end = first[short], end[short]
    sums, down = _sums(t.hash)
    return first, end - first, B.mix(((sums[end] - sums[first]) * down[first]) ^ salt[first] ^ _BLOCK)


def counted(prints: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, in order, and on how many distinct pages each is."""
    f, p = np.concatenate(prints), np.concatenate(pages)
    order = np.lexsort((p, f))
    f, p = f[order], p[order]
    new = np.append(True, f[1:] != f[:-1])
    fresh = new | np.append(True, p[1:] != p[:-1])
    at = np.flatnonzero(new)
    return f[at], np.add.reduceat(fresh.astype(np.int64), at)


def covered(t: Tokens, starts: np.ndarray, least: int | np.ndarray) -> np.ndarray:
    """Tokens within ``least`` tokens (for each start, or for all) from one of the starts on."""
    depth = np.zeros(len(t.hash) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + least, -1)
    return np.cumsum(depth[:-1]) > 0


def kept_text(t: Tokens, boiler: np.ndarray, n: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each of n pages: the words that are left, how many runs and words these are, and how many words it had.

    A line ends where boilerplate was left out or a block tag stands.
    """
    words = np.flatnonzero(~t.tag)
    keep = words[~boiler[words]]
    total, left = np.bincount(t.page[words], minlength=n), np.bincount(t.page[keep], minlength=n)
    gone = np.concatenate([[0], np.cumsum(boiler & ~t.tag)])
    block = np.concatenate([[0], np.cumsum(t.tag & within(t.hash, _BREAKS))])
    first = np.append(True, t.page[keep][1:] != t.page[keep][:-1]) if len(keep) else np.zeros(0, bool)
    cut_off, line = first.copy(), first.copy()
    if len(keep):
        cut_off[1:] |= gone[keep[1:]] > gone[keep[:-1]]
        line[1:] |= cut_off[1:] | (block[keep[1:]] > block[keep[:-1]])
    runs = np.bincount(t.page[keep], cut_off, n).astype(np.int64)
    size = t.end[keep] - t.start[keep] + 1  # with the sign before it
    end = np.cumsum(size)
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    begin = end - size
    out[begin[line]] = 10
    index = np.arange(len(out)) - np.repeat(begin - t.start[keep] + 1, size)
    body = np.ones(len(out), bool)
    body[begin] = False
    out[body] = t.data[index[body]]
    raw, bounds = out.tobytes(), np.concatenate([[0], end])[np.searchsorted(t.page[keep], np.arange(n + 1))]
    texts = [raw[i + 1 : j].decode("utf-8", "replace") for i, j in zip(bounds[:-1], bounds[1:])]
    return [html.unescape(x) if "&" in x else x for x in texts], runs, left, total


_BREAKS = np.sort(_of_tags(_BLOCK_TAGS))
_FRAMES = _of_tags(_FRAME).reshape(-1, 2)
#: Tells the fingerprints of blocks from those of suffixes.
_BLOCK = np.uint64(0x9FB21C651E98DF25)


def _salts(batch: pa.RecordBatch, t: Tokens) -> np.ndarray:
    return batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)[t.page]


def _markers(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each page that no fingerprint has (but by chance)."""
    return B.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(0xA24BAED4963EE407))


def _merge(pages: DataFrame, find: Callable[[pa.RecordBatch, News], tuple[np.ndarray, np.ndarray]], told: str | None, least_pages: int, name: str) -> str:
    """The folder that tells each task which of its fingerprints are on enough distinct pages.

    ``find`` gives the fingerprints of a batch as (fingerprint, page of the batch), knowing what the folder ``told`` says. The
    pages' own markers are told, too, so that a task can see that it has the same pages again.
    """
    folder = shared_folder(pages.sparkSession, name)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId()
        news = News(told, unit)
        prints: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = before = 0

        def rows(f: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(f), 1 << 16):
                k = len(f[lo : lo + (1 << 16)])
                yield pa.record_batch([pa.array(f[lo : lo + k].view(np.int64)), pa.array(n[lo : lo + k].astype(np.int32)), pa.array(np.full(k, unit, np.int32))], ["f", "n", "unit"])

        for batch in batches:
            for part in B.slices(batch, "html"):
                f, p = find(part, news.of(part))
                prints.append(f)
                owners.append((p + before).astype(np.int32))
                before += part.num_rows
                held += len(f)
                yield from rows(_markers(part), np.full(part.num_rows, least_pages))
                if held > _HELD:
                    yield from rows(*counted(prints, owners))
                    prints, owners, held, before = [], [], 0, 0
        if held:
            yield from rows(*counted(prints, owners))

    sent = pages.mapInArrow(of, "f long, n int, unit int")
    total = F.sum("n").over(Window.partitionBy("f"))
    shared = sent.withColumn("total", total).where(F.col("total") >= least_pages).select("unit", "f", F.floor(F.col("unit") / _UNITS).alias("units"))
    shared.repartition("unit").sortWithinPartitions("units", "unit").write.partitionBy("units").parquet(folder)
    return folder


class News:
    """What a task was told about its fingerprints, read when it is first asked for."""

    def __init__(self, folder: str | None, unit: int):
        self.folder, self.unit = folder, unit
        self.known: np.ndarray | None = None
        self.own = True

    def _files(self, path: str) -> Iterator[pq.ParquetFile]:
        fs, root = pafs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pafs.LocalFileSystem(), self.folder)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/{path}", recursive=True, allow_not_found=True))
        for f in found:
            if f.is_file and f.path.endswith(".parquet"):
                yield pq.ParquetFile(fs.open_input_file(f.path))

    def _told(self) -> np.ndarray:
        got = [np.zeros(0, np.uint64)]
        for file in self._files(f"units={self.unit // _UNITS}"):
            for n in range(file.num_row_groups):
                at = file.metadata.row_group(n).column(file.schema_arrow.get_field_index("unit")).statistics
                if at is None or not at.has_min_max or at.min <= self.unit <= at.max:
                    rows = file.read_row_group(n, ["unit", "f"])
                    got.append(rows["f"].to_numpy()[rows["unit"].to_numpy() == self.unit].view(np.uint64))
        return np.unique(np.concatenate(got))

    def of(self, batch: pa.RecordBatch) -> News:
        if self.folder is not None:
            if self.known is None:
                self.known = self._told()
            # Where the source gave this task other pages than before, it has to ask what all were told.
            self.own = bool(within(_markers(batch), self.known).all())
        return self

    def knows(self, values: np.ndarray) -> np.ndarray:
        """Which of the batch's fingerprints are shared."""
        if self.own:
            return within(values, self.known if self.known is not None else np.zeros(0, np.uint64))
        # What any page was told holds for all; it is gone through in pieces, and only what is asked for is kept.
        asked = np.unique(values)
        found = np.zeros(len(asked), bool)
        for file in self._files(""):
            for rows in file.iter_batches(1 << 16, columns=["f"]):
                found |= np.isin(asked, rows.column(0).to_numpy().view(np.uint64))
        return within(values, asked[found])


def extract(pages: DataFrame, least: int = LEAST, gram: int = GRAM, least_pages: int = PAGES, few: int | None = None) -> DataFrame:
    """(page_id, host, text, n_runs, n_kept, n_words) of each page.

    ``text`` is what is left of the page's words without substrings of at least ``least`` tokens that are on
    ``least_pages`` distinct pages of its host and, if ``few`` is given, without shorter blocks (of ``few`` words, or elements of the frame) that are; ``n_runs`` is in how many pieces, ``n_kept`` and ``n_words`` count words left and
    words there were. A host is the url's, in lower case; pages without one (a null url, too) share the empty host.

    A null or empty html has no words: an empty text. A page of fewer than ``least`` tokens loses
    nothing but shared blocks. Rows that
    repeat a page_id are one page (that of the least url and html) and give one row; rows with a null page_id
    are pages of their own. A substring that is repeated on one page only is kept. Pages are read whole, however
    long: all text counts, that of the title and of noscript, template and svg elements, too, but for comments, scripts and
    styles; where such a one isn't closed, it is text. An empty table gives no rows; other columns aren't looked at. Different substrings are taken for
    equal if their 64-bit fingerprints are, which a corpus of 10^9 distinct ones has a chance of 3 in 100 for.
    """
    own = pages.select(q("page_id").cast("long").alias("page_id"), q("url").cast("string").alias("url"), q("html").cast("string").alias("html"))
    if not own.where("page_id is not null").groupBy("page_id").count().where("count > 1").isEmpty():
        one = own.where("page_id is not null").groupBy("page_id").agg(F.min(F.struct("url", "html")).alias("p")).select("page_id", "p.*")
        own = cut(one.unionByName(own.where("page_id is null")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    base = own.select(F.xxhash64("page_id", "url").alias("marker"), F.xxhash64(host).alias("salt"), F.coalesce("html", F.lit("")).alias("html"), "page_id", host.alias("host"))
    slim = base.select("marker", "salt", "html")

    def gram_anchors(batch: pa.RecordBatch, _: News) -> tuple[np.ndarray, np.ndarray]:
        t = tokens(B.strings(batch.column(2)))
        salt = _salts(batch, t)
        g, a = anchored(t, salt, least, gram)
        there = np.unique(a[suffixes(t, salt, least)[0]])
        return g[there], t.page[there]

    def candidates(batch: pa.RecordBatch, news: News) -> tuple[np.ndarray, np.ndarray]:
        t = tokens(B.strings(batch.column(2)))
        salt = _salts(batch, t)
        first, _, b = blocks(t, salt, least, few)
        at, page = repeats(t, salt, least)
        g, a = anchored(t, salt, least, gram)
        can = news.knows(g[a[at]])
        f = grams(t.hash, least, salt)
        return np.concatenate([f[at[can]], b]), np.concatenate([page[can], t.page[first]])

    told = _merge(slim, candidates, _merge(slim, gram_anchors, None, least_pages, "anchors"), least_pages, "suffixes")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        news = News(told, TaskContext.get().partitionId())
        for batch in batches:
            for part in B.slices(batch, "html"):
                t = tokens(B.strings(part.column(2)))
                salt = _salts(part, t)
                at, f = suffixes(t, salt, least)
                first, size, b = blocks(t, salt, least, few)
                shared = news.of(part).knows(np.concatenate([f, b]))
                at, shared = at[shared[: len(f)]], shared[len(f) :]
                boiler = covered(t, np.concatenate([at, first[shared]]), np.concatenate([np.full(len(at), least), size[shared]]))
                text, runs, left, total = kept_text(t, boiler, part.num_rows)
                ints = [pa.array(v.astype(np.int32)) for v in (runs, left, total)]
                yield pa.record_batch([part.column("page_id"), part.column("host"), pa.array(text, pa.string()), *ints], ["page_id", "host", "text", "n_runs", "n_kept", "n_words"])

    return base.mapInArrow(of, "page_id long, host string, text string, n_runs int, n_kept int, n_words int")
