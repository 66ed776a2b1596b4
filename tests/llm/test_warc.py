from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib

import pyarrow.fs as pafs
import pytest

from pitchlake.llm import warc as W


def salvaged(data, tmp_path):
    p = tmp_path / "f.warc"
    p.write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(str(p)) as f:
        return [(f.offset, f.length, f.reason, f.record and f.record.header, f.part) for f in W.salvage(W.Window(f, len(data)))]


def made(n, packed, seed=0):
    r = random.Random(seed)
    out = [W.record(f"http://h/{k}", f"urn:page:{k}", bytes(r.choices(range(256), k=r.randint(0, 4000)))) for k in range(n)]
    return [W.compressed(x) for x in out] if packed else out


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_damage_loses_only_what_it_hits(tmp_path, packed, seed):
    r = random.Random(seed)
    good = made(40, packed, seed)
    data, want, gaps = b"", [], 0
    for k, x in enumerate(good):
        kind = r.choice(["ok", "ok", "ok", "flip", "cut", "junk"])
        if kind == "flip":
            i = r.randrange(len(x))
            x, kind = x[:i] + bytes([x[i] ^ (1 << r.randrange(8))]) + x[i + 1 :], "lost"
        elif kind == "cut":
            x, kind = x[: r.randrange(1, len(x))], "lost"
        elif kind == "junk":
            data += bytes(r.choices(range(256), k=50)) + b"WARC/1.0 no\r\n\x1f\x8b\x08"
        want += [(len(data), len(x), k)] if kind != "lost" else []
        data += x
    got = salvaged(data, tmp_path)
    records = [(o, n, int((re.findall(r"\d+", h["warc-record-id"]) or [-1])[0])) for o, n, reason, h, _ in got if reason is None]
    lost = set(want) - set(records)
    assert not lost  # some of the changed bits hit a field that no check covers; such a record is read, too
    at = 0
    for o, n, *_ in got:  # records and gaps cover the file, each byte once
        assert o == at and n > 0
        at += n
    assert at == len(data)
    assert all(a[2] is None or b[2] is None for a, b in zip(got, got[1:]))  # adjoining gaps are one


def test_odd_files(tmp_path):
    assert salvaged(b"", tmp_path) == []
    (gap,) = salvaged(b"no record here", tmp_path)
    assert gap[:3] == (0, 14, "no record mark")
    whole = made(3, False)
    assert [g[2] for g in salvaged(b"".join(whole)[:-1], tmp_path)] == [None, None, "content length"]
    mixed = whole[0] + gzip.compress(whole[1]) + whole[2]
    assert [g[2] for g in salvaged(mixed, tmp_path)] == [None] * 3
    huge = W.record("http://h/", "urn:page:1", b"x" * (3 * W.CHUNK))
    far = b"\0" * (2 * W.CHUNK + 5)
    assert [(g[0], g[2]) for g in salvaged(far + huge + far, tmp_path)] == [(0, "no record mark"), (len(far), None), (len(far) + len(huge), "no record mark")]


def test_checks(tmp_path):
    x = W.record("u", "i", b"body")
    assert salvaged(x.replace(b"body", b"bodx"), tmp_path)[0][2] == "block digest"
    assert salvaged(x.replace(b"Length: 4", b"Length: 40"), tmp_path)[0][2] == "content length"
    assert salvaged(x.replace(b"Content-Length: 4", b"Content-Length"), tmp_path)[0][2] == "header line"
    assert salvaged(x.replace(b"sha1:", b"none:"), tmp_path)[0][2] is None


def test_valid_forms_are_read(tmp_path):
    x = W.record("u", "i", b"body")
    folded = x.replace(b"Content-Type: text/html", b"Content-Type: text/html;\r\n charset=utf-8")
    assert salvaged(folded, tmp_path)[0][3]["content-type"] == "text/html; charset=utf-8"
    for version in (b"WARC/0.17", b"WARC/0.18", b"WARC/1.0", b"WARC/1.1"):
        assert [g[2] for g in salvaged(x.replace(b"WARC/1.0", version) * 2, tmp_path)] == [None, None]
    long = x.replace(b"Content-Type:", b"X-Long: " + b"y" * 200_000 + b"\r\nContent-Type:")
    assert [g[2] for g in salvaged(long + x, tmp_path)] == [None, None]
    endless = b"WARC/1.0\r\n" + b"z" * 3_000_000
    assert [g[2] for g in salvaged(endless + b"\r\n" + x, tmp_path)][-1] is None


def test_several_records_in_a_member(tmp_path):
    good = made(5, False, 3)
    member = gzip.compress(b"".join(good))
    got = salvaged(member + W.compressed(good[0]), tmp_path)
    assert [(g[0], g[1], g[4]) for g in got] == [(0, len(member), k) for k in range(5)] + [(len(member), len(W.compressed(good[0])), 0)]
    bad = good[2].replace(b"Content-Length", b"Content-Lengt")
    got = salvaged(gzip.compress(b"".join([*good[:2], bad, *good[3:], b"junk"])), tmp_path)
    assert [g[2] is None for g in got] == [True, True, False, True, True, False] and [g[4] for g in got] == list(range(6))


@pytest.mark.parametrize("packed", [False, True])
def test_long_records_are_checked_in_chunks(tmp_path, packed):
    block = bytes(range(256)) * (40 << 10)  # 10 MB
    x = W.record("u", "i", block)
    y = x[: len(x) // 2] + b"?" + x[len(x) // 2 + 1 :]
    data = b"".join(W.compressed(v) if packed else v for v in (x, y, x))
    p = tmp_path / "f.warc"
    p.write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(str(p)) as f:
        w, most = W.Window(f, len(data)), 0
        got = []
        for r in W.salvage(w):
            got.append((r.reason, r.record and r.record.n_bytes))
            most = max(most, len(w.held))
    assert [g for g in got if g[0] is None] == [(None, len(block))] * 2 and got[1][0] == "block digest" and most < 5 * W.CHUNK


def plain_reader(data):
    """(offset, length, id) of the records that a walk over every byte finds, the plainest way: no window, no search."""
    at, out = 0, []
    while at < len(data):
        end = None
        raw, used = data[at:], None
        if raw[:3] == b"\x1f\x8b\x08":
            d = zlib.decompressobj(31)
            try:
                raw = d.decompress(raw)
                used = len(data) - at - len(d.unused_data) if d.eof else None
            except zlib.error:
                used = None
            raw = raw if used else b""
        m = re.match(rb"WARC/1\.0\r\n(.*?)\r\n\r\n", raw, re.S)
        if m:
            try:
                lines = m.group(1).decode("utf-8", "replace").split("\r\n")
                h = {x.partition(":")[0].lower(): x.partition(":")[2].strip() for x in lines}
                sound = all(re.match(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+:[^\n]*$", x) for x in lines) and len(h) == len(lines)
                n = int(h["content-length"]) if sound and h.keys() >= {"warc-type", "warc-record-id"} and h["content-length"].isascii() else -1
                block = raw[m.end() : m.end() + n]
                digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
                algorithm, _, value = h.get("warc-block-digest", ":").partition(":")
                good = n >= 0 and raw[m.end() + n :][:4] == b"\r\n\r\n" and (algorithm.lower() != "sha1" or value.upper() == digest)
                end = (used or m.end() + n + 4) if good and (not used or len(raw) == m.end() + n + 4) else None
            except (ValueError, KeyError):
                end = None
        if end:
            out.append((at, end, h["warc-record-id"]))
        at += end or 1
    return out


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_reader_equals_a_walk_over_every_byte(tmp_path, packed, seed):
    r = random.Random(seed)
    data = b""
    for k, x in enumerate(made(25, packed, seed)):
        i = r.randrange(0 if packed else x.find(b"\r\n\r\n") + 4, len(x))  # what changes is in a block or a member
        data += r.choice([x, x, x[:i] + bytes([x[i] ^ 0x20]) + x[i + 1 :], x[:i], b"\r\nWARC/1.0\r\n" + x])
    got = [(o, n, h["warc-record-id"]) for o, n, reason, h, _ in salvaged(data, tmp_path) if reason is None]
    assert got == plain_reader(data)


def test_unreadable_files_are_gaps(spark, tmp_path):
    (tmp_path / "good.warc").write_bytes(b"".join(made(3, False)))
    (tmp_path / "folder").mkdir()
    paths = [str(tmp_path / "good.warc"), str(tmp_path / "missing.warc"), str(tmp_path / "folder"), "nofs://x/y"]
    got = W.read(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sum(r["kind"] == "record" for r in got) == 3
    assert {r["path"] for r in got if r["kind"] == "gap" and r["reason"].startswith("unreadable") and r["length"] == 0} == set(paths[1:])
    none = spark.createDataFrame([], "path string")
    assert W.read(none).isEmpty() and W.read(none).columns == W._NAMES


DDL = "page_id bigint, url string, html string"


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}é</p>" * k) for k in range(60)] + [(None, None, None), (5, "http://h/5", "again"), (99, "a\nb", "y" * 2_000_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", path string, offset int").repartition(3)
    files = W.write(df, str(tmp_path / "w"), file_bytes=20_000)
    listing = files.collect()
    assert sum(f["n_records"] for f in listing) == len(rows) and len({f["path"].endswith("gz") for f in listing}) == 2
    got = W.read(spark.createDataFrame([(f["path"],) for f in listing] + [(None,)], "path string"), with_block=True).collect()
    assert {r["kind"] for r in got} == {"record"}
    want = sorted((f"<urn:page:{'null' if p is None else p}>", (x or "").encode()) for p, _, x in rows)
    assert sorted((r["record_id"], bytes(r["block"])) for r in got) == want
    assert W.write(df, str(tmp_path / "w"), file_bytes=20_000).count() == len(listing)  # a second run leaves the same files
    assert len([p for p in (tmp_path / "w").iterdir() if p.name.startswith("part") and p.suffix != ".crc"]) == len(listing)


def test_query_recovers_all_but_the_damaged(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 30) for k in range(700)]
    df = spark.createDataFrame(rows, DDL)
    got = W.salvaged_pages(df).collect()
    lost = {k for k, *_ in rows if k % 53 == 1 or k % 211 == 2}
    assert {r["page_id"] for r in got if r["kind"] == "record"} == set(range(700)) - lost
    assert any(r["kind"] == "gap" for r in got)
    assert W.salvaged_pages(df.limit(0)).isEmpty()
