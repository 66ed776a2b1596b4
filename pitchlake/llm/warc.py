"""WARC files: a writer, and a reader that salvages what damage leaves.

The reader checks every record: the gzip member's own checksum, the version line, the header and its needed
fields, the content length, the closing blank lines and the block digest. After a failed check it searches on for the next gzip
magic number or version line at which all checks pass, goes on from there, and reports the bytes between as
a quarantined gap. Records and gaps together cover each file exactly once.

A file is read by one task from start to end, in chunks, whatever the length of its records; files are spread over the
cluster.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import cut, q, shared_folder

#: Bytes of a file, about.
FILE_BYTES = 256 << 20
CHUNK = 1 << 20

_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.\d)\r?\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/[01]\.")
#: What a line of a header may begin with: a field's name and its colon, or the space of a folded line.
_FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*(:)?|[ \t]")
#: Fields that a header has once, or the end of one record was lost with the start of the next.
_ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-target-uri", "warc-block-digest"}
_NEEDED = {"warc-type", "warc-record-id", "content-length"}
FIELDS = "kind string, path string, offset long, length long, part int, reason string, record_type string, record_id string, target_uri string, content_type string, n_bytes long, md5 string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


class Damaged(Exception):
    """Why the bytes at a place aren't a whole record."""


class Source:
    """Bytes from ``base`` on, held as they are needed; subclasses bring on more of them."""

    def __init__(self) -> None:
        self.base, self.held = 0, bytearray()

    def upto(self, end: int) -> int:
        """Read on to ``end``, or to the end; gives how far it is."""
        raise NotImplementedError

    def slice(self, start: int, end: int) -> bytes:
        end = self.upto(end)
        return bytes(memoryview(self.held)[start - self.base : max(start, end) - self.base])

    def drop(self, before: int) -> None:
        if before - self.base >= CHUNK:
            del self.held[: before - self.base]
            self.base = before

    def search(self, start: int) -> int:
        """The next place at or after ``start`` where a record may begin; the end where there is none."""
        while True:
            have = self.upto(start + CHUNK)
            m = _CANDIDATE.search(self.held, start - self.base, have - self.base)
            if m:
                return self.base + m.start()
            if have < start + CHUNK:
                return have
            start = have - 6  # a mark may lie across the chunks
            self.drop(start)


class Window(Source):
    """A file's bytes; what was dropped is read again where it is asked for."""

    def __init__(self, file: pa.NativeFile, size: int):
        super().__init__()
        self.file, self.size = file, size

    def upto(self, end: int) -> int:
        end = min(end, self.size)
        while self.base + len(self.held) < end:
            at = self.base + len(self.held)
            got = self.file.read_at(min(max(CHUNK, end - at), self.size - at), at)
            if not got:
                self.size = at
                break
            self.held += got
        return min(end, self.base + len(self.held))

    def slice(self, start: int, end: int) -> bytes:
        if self.base <= start and end <= self.base + 4 * CHUNK:
            return super().slice(start, end)
        return self.file.read_at(max(0, min(end, self.size) - start), start)  # past the window, so that it stays small

    def chunks(self, start: int, end: int) -> Iterator[bytes]:
        for lo in range(start, end, CHUNK):
            yield self.slice(lo, min(lo + CHUNK, end))


class Member(Source):
    """What a gzip member at ``at`` of a file holds; it is read anew where a place before is asked for."""

    def __init__(self, file: Window, at: int):
        super().__init__()
        self.file, self.at = file, at
        self._open()

    def _open(self) -> None:
        self.base, self.held, self.place, self.d = 0, bytearray(), self.at, zlib.decompressobj(31)

    def upto(self, end: int) -> int:
        while self.base + len(self.held) < end and not self.d.eof:
            raw = self.d.unconsumed_tail
            if not raw:
                raw = b"".join(self.file.chunks(self.place, min(self.file.size, self.place + (CHUNK >> 2))))
                self.place += len(raw)
            try:
                got = self.d.decompress(raw, CHUNK)
            except zlib.error as e:
                raise Damaged("gzip member") from e
            if not raw and not got and not self.d.eof:
                raise Damaged("gzip member cut short")
            self.held += got
        return min(end, self.base + len(self.held))

    def slice(self, start: int, end: int) -> bytes:
        if start < self.base:
            self._open()
            self.skip(start)
        return super().slice(start, end)

    def skip(self, to: int) -> None:
        """Go on to a place without holding what is before it."""
        for lo in range(self.base, to, CHUNK):
            self.upto(min(lo + CHUNK, to))
            self.drop(min(lo + CHUNK, to))

    def chunks(self, start: int, end: int) -> Iterator[bytes]:
        for lo in range(start, end, CHUNK):
            yield self.slice(lo, min(lo + CHUNK, end))
            self.drop(min(lo + CHUNK, end))

    def end(self) -> int:
        """Where the member ends in the file; all of it is read, so that its checksum is tested."""
        at = self.base + len(self.held)
        while not self.d.eof:
            at = self.upto(at + CHUNK)
            self.drop(at)
        return self.place - len(self.d.unused_data)


def header_at(w: Source, at: int) -> tuple[int, dict[str, str]]:
    """(length, fields) of a header, of any length: it is read on as long as its lines are fields."""
    have, line = 4096, 0
    head = w.slice(at, at + have)
    m = _VERSION.match(head)
    if not m:
        raise Damaged("version line")
    line = m.end()
    lines: list[bytes] = []
    while True:
        stop = head.find(b"\n", line)
        rest = head[line : stop if stop >= 0 else len(head)]
        if rest.rstrip(b"\r") == b"" and stop >= 0:
            return stop + 1, parse_header(lines)
        name = _FIELD.match(rest)
        if rest and (not name or name.end() < len(rest) and not name.group(1) and rest[:1] not in b" \t"):
            raise Damaged("header line")
        if stop >= 0:
            lines.append(rest)
            line = stop + 1
            continue
        more = w.slice(at, at + 2 * have)
        if len(more) == len(head):
            raise Damaged("header end")
        head, have = more, 2 * have


def parse_header(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r")
        if line[0] in " \t":  # folded: it goes on with the field before
            if not name:
                raise Damaged("header line")
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line")
        name = name.strip().lower()
        if name in out and name in _ONCE:
            raise Damaged("header of two records")
        out[name] = value.strip()
    if not out.keys() >= _NEEDED:
        raise Damaged("header field missing")
    return out


def _content_length(header: dict[str, str]) -> int:
    value = header.get("content-length", "")
    if not (value.isascii() and value.isdecimal()):
        raise Damaged("content length")
    return int(value)


def _hasher(name: str):
    try:
        return hashlib.new(name.strip().lower().replace("-", ""), usedforsecurity=False)
    except ValueError:
        return None  # an unknown algorithm can't be checked


@dataclass
class Record:
    """A whole record: where it ends in its source, its header, and what there is to say of its block."""

    end: int
    header: dict[str, str]
    n_bytes: int
    md5: str
    block: bytes | None


def record_in(w: Source, at: int, with_block: bool) -> Record:
    """The record whose version line is at ``at``; its block goes through the checks in chunks, whatever its length."""
    n, header = header_at(w, at)
    start, size = at + n, _content_length(header)
    end = start + size
    if isinstance(w, Window):  # at random access the end is looked at first
        if end > w.size:
            raise Damaged("content length")
        if not (m := _BLANK.match(w.slice(end, end + 4))):
            raise Damaged("content length")
    name, _, digest = header.get("warc-block-digest", "").partition(":")
    own, md5, parts, had = (_hasher(name) if name else None), hashlib.md5(usedforsecurity=False), [], 0
    for chunk in w.chunks(start, end):
        md5.update(chunk)
        if own:
            own.update(chunk)
        if with_block:
            parts.append(chunk)
        had += len(chunk)
        if not chunk:
            break
    if not isinstance(w, Window):
        tail = w.slice(end, end + 4) if had == size else b""
        if not (m := _BLANK.match(tail)):
            raise Damaged("content length")
    if own and digest.strip().lower() != own.hexdigest() and digest.strip().upper() != base64.b32encode(own.digest()).decode():
        raise Damaged("block digest")
    return Record(end + m.end(), header, size, md5.hexdigest(), b"".join(parts) if with_block else None)


_BLANK = re.compile(rb"\r?\n\r?\n")


@dataclass
class Found:
    """A record, or (with a reason) a gap: its place in the file. ``part`` counts what one gzip member holds."""

    offset: int
    length: int
    part: int
    reason: str | None
    record: Record | None


def _member(file: Window, at: int, with_block: bool) -> list[Found]:
    """All that a gzip member holds, if its own checksum holds and at least one record is whole."""
    w = Member(file, at)
    rows: list[tuple[int, str | None, Record | None]] = []
    inner, gap, reason = 0, 0, None
    while w.upto(inner + 1) > inner:
        try:
            got = record_in(w, inner, with_block)
        except Damaged as e:
            if str(e).startswith("gzip"):
                raise
            if reason is None:
                gap, reason = inner, str(e)
            w.slice(inner, inner + 1)  # back to where it failed, if the search has gone on
            inner = w.search(inner + 1)
            continue
        if reason is not None:
            rows.append((inner - gap, reason, None))
            reason = None
        rows.append((got.n_bytes, None, got))
        inner = got.end
        w.drop(inner)
    length = w.end() - at
    if reason is not None:
        rows.append((inner - gap, reason, None))
    if not any(r for _, _, r in rows):
        raise Damaged(reason or "empty member")
    return [Found(at, length, k, why, r or Record(0, {}, n, "", None)) for k, (n, why, r) in enumerate(rows)]


def records_at(w: Window, at: int, with_block: bool) -> list[Found]:
    mark = w.slice(at, at + 3)
    if mark == _MAGIC:
        return _member(w, at, with_block)
    if mark == b"WAR":
        r = record_in(w, at, with_block)
        return [Found(at, r.end - at, 0, None, r)]
    raise Damaged("no record mark")


def salvage(w: Window, with_block: bool = False) -> Iterator[Found]:
    """Records and gaps over the whole file, each byte once: those of one gzip member share its place."""
    at = gap = 0
    reason: str | None = None
    while at < w.size:
        try:
            found = records_at(w, at, with_block)
        except Damaged as e:
            if reason is None:
                gap, reason = at, str(e)
            at = w.search(at + 1)
            w.drop(at)
            continue
        if reason is not None:
            yield Found(gap, at - gap, 0, reason, None)
            reason = None
        yield from found
        at += found[0].length
        w.drop(at)
    if reason is not None:
        yield Found(gap, w.size - gap, 0, reason, None)


def read(files: DataFrame, with_block: bool = False) -> DataFrame:
    """Records and gaps of WARC files, plain or compressed: one row each, ``kind`` 'record' or 'gap'.

    ``files`` has a column ``path`` (a path or URI that pyarrow can open). Columns: kind, path, offset and length in
    the stored file, part, reason (of a gap), record_type, record_id, target_uri, content_type, n_bytes and md5 of the
    block, and the block itself if wanted. Records and headers may be of any length; the checks read them in chunks, and only
    a block that is wanted is held. Records of one gzip member have its offset and length and are told apart by
    ``part``, from 0; a gap within a member whose checksum holds is told by its reason and its bytes (n_bytes) there.

    A null path is skipped, an empty file gives no rows, a file without any whole record is one gap, one that is missing or
    can't be read is a gap of no length (from where reading failed), and a path given twice is read twice. Header fields
    that are absent are null. Other columns are not looked at.
    """
    schema = FIELDS + (", block binary" if with_block else "")
    names = _NAMES + (["block"] if with_block else [])

    def rows_of(path: str) -> Iterator[tuple]:
        at = 0
        try:
            fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
            with fs.open_input_file(name) as file:
                for f in salvage(Window(file, file.size()), with_block):
                    at = f.offset + f.length
                    r = f.record
                    if f.reason is None:
                        h = r.header
                        yield ("record", path, f.offset, f.length, f.part, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("content-type"), r.n_bytes, r.md5, r.block)
                    else:
                        yield ("gap", path, f.offset, f.length, f.part, f.reason, None, None, None, None, r.n_bytes if r else None, None, None)
        except (OSError, pa.ArrowInvalid) as e:
            yield ("gap", path, at, 0, 0, f"unreadable: {type(e).__name__}", None, None, None, None, None, None, None)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows_of(path):
                    rows.append(row[: len(names)])
                    held += len(row[-1] or b"") + 400
                    if held > 4 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, names)

    return files.select(q("path").cast("string").alias("path")).where("path is not null").mapInArrow(of, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "part": pa.int32(), "n_bytes": pa.int64(), "block": pa.binary()}
    return pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def record(uri: str, record_id: str, block: bytes, content_type: str = "text/html", date: str = "1970-01-01T00:00:00Z") -> bytes:
    digest = base64.b32encode(hashlib.sha1(block, usedforsecurity=False).digest()).decode()
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {content_type}\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def damaged(page_id: int, data: bytes) -> bytes:
    """What a bad disk leaves of a record: a changed byte, a cut or bytes before it, for some pages; else all of it."""
    if page_id % 53 == 1:
        return data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 0x55]) + data[len(data) // 2 + 1 :]
    if page_id % 211 == 2:
        return data[: len(data) // 3]
    if page_id % 307 == 3:
        return b"\0" * 100 + b"WARC/1.0 is not a record" + data
    return data


def write(pages: DataFrame, folder: str, damage: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(path, n_records) of the WARC files that pages (page_id, url, html) are written to, every other one compressed.

    Each task writes its own files under names that it would use again, so one that runs twice leaves one copy. A
    null html is an empty block, a null url an empty one, a null id is written as ``null``.
    """
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    fs.create_dir(root, recursive=True)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        task = TaskContext.get()
        number, size, n = 0, 0, 0
        name = part = ""
        out = None
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal number, size, n, out
            out.close()
            try:
                fs.move(part, f"{root}/{name}")
            except OSError:  # some file systems don't replace what an earlier attempt left
                fs.delete_file(f"{root}/{name}")
                fs.move(part, f"{root}/{name}")
            done.append((f"{folder.rstrip('/')}/{name}", n))
            number, size, n, out = number + 1, 0, 0, None

        for batch in batches:
            ids = batch.column(0).to_pylist()
            urls, html = B.strings(batch.column(1)).to_pylist(), batch.column(2).cast(pa.large_binary())
            for k, page in enumerate(ids):
                packed = (number + task.partitionId()) % 2 == 0
                if out is None:
                    name = f"part-{task.partitionId():06d}-{number:04d}.warc" + ".gz" * packed
                    part = f"{root}/.{name}.{task.taskAttemptId()}"
                    out = fs.open_output_stream(part)
                raw = html[k].as_py() or b""
                data = record(re.sub(r"\s", "", urls[k]), f"urn:page:{'null' if page is None else page}", raw)
                data = compressed(data) if packed else data
                if damage and page is not None:
                    data = damaged(page, data)
                out.write(data)
                size += len(data)
                n += 1
                if size >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["path", "n_records"])

    return pages.select(q("page_id").cast("long").alias("page_id"), q("url").cast("string").alias("url"), q("html").cast("string").alias("html")).mapInArrow(of, "path string, n_records long")


def salvaged_pages(pages: DataFrame) -> DataFrame:
    """The pages written as WARC files with some damage to the shared folder, and read again by the salvage reader.

    Columns as ``read`` gives them, the path without its folder, and page_id from the record's id.
    """
    files = cut(write(pages, shared_folder(pages.sparkSession, "warc"), damage=True))
    # A file is a task; there are at most as many as tasks that wrote, or as the bytes fill.
    listing = files.repartition(max(1, files.count()), F.hash("path"))
    got = read(listing)
    page = F.regexp_extract("record_id", r"^<urn:page:(\d+)>$", 1).try_cast("long")
    return got.withColumn("page_id", page).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
