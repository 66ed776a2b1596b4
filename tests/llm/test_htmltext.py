from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from pitchlake.llm import bytesops as B
from pitchlake.llm import htmltext as H
from pitchlake.llm import queries as Q

DDL = "page_id bigint, url string, html string"
DROP = re.compile(r"<!--.*?-->|<(script|style)(?![a-z0-9-]).*?</\1(?![a-z0-9-])[^>]*(?:>|\Z)", re.S | re.I)


def plain_tokens(page):
    """(is a tag, token) one after another, by one regular expression."""
    page = DROP.sub(" ", page or "")
    out = []
    for m in re.finditer(r"<(?=[A-Za-z/!?])[^>]*(?:>|\Z)|(?:[^<\s]|<(?![A-Za-z/!?]))+", page):
        if m[0][0] == "<" and re.match(r"<[A-Za-z/!?]", m[0]):
            out.append((True, re.match(r"</?[A-Za-z0-9-]*", m[0])[0].lower()))
        else:
            out.append((False, m[0]))
    return out


def brute_force(pages, least, least_pages):
    """{page: words left} of (page, host, html)."""
    streams = {p: (h, plain_tokens(x)) for p, h, x in pages}
    where = {}
    for p, (h, t) in streams.items():
        for i in range(len(t) - least + 1):
            where.setdefault((h, tuple(t[i : i + least])), set()).add(p)
    left = {}
    for p, (h, t) in streams.items():
        gone = set()
        for i in range(len(t) - least + 1):
            if len(where[h, tuple(t[i : i + least])]) >= least_pages:
                gone |= set(range(i, i + least))
        left[p] = [html.unescape(w) for i, (tag, w) in enumerate(t) if not tag and i not in gone]
    return left


def made_pages(seed, n=40):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["é", "&amp;", "a<b"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [f"<nav><ul><li><a href='/x'>{line(3)}</a></li></ul></nav>{line(14)}" for _ in range(3)] + [line(12), line(25)]
    pages = []
    for k in range(n):
        parts = [line(r.randint(0, 30)) for _ in range(3)] + [r.choice(shared) for _ in range(r.randint(0, 3))]
        r.shuffle(parts)
        page = f"<html><head><title>{line(3)}</title></head><body><!-- {k} --><script>var a = '</p>';</script>" + "".join(f"<p>{x}</p>" for x in parts) + "<br/>" + f"<footer>{shared[0]}</footer></body></html>"
        pages.append((k, f"http://{'ABc'[k % 3]}.org:80/{k}", page))
    return pages


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, parts):
    pages = made_pages(seed)
    for least, gram, many in ((8, 4, 2), (16, 6, 3)):
        df = spark.createDataFrame(pages, DDL).coalesce(1) if parts == 1 else spark.createDataFrame(pages, DDL).repartition(parts)
        got = {r["page_id"]: r for r in H.extract(df, least, gram, many).collect()}
        want = brute_force([(p, u[7].lower(), x) for p, u, x in pages], least, many)
        assert {p: r["text"].split() for p, r in got.items()} == {p: " ".join(w).split() for p, w in want.items()}
        assert all(r["n_kept"] <= r["n_words"] and r["host"] in ("a.org", "b.org", "c.org") for r in got.values())


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_equals_sorted_suffixes(seed):
    r = random.Random(seed)
    page = np.repeat(np.arange(8), [r.randint(0, 40) for _ in range(8)])
    token = np.array([r.randrange((2, 3, 50)[seed % 3]) for _ in page], np.uint64)
    sa = H.suffix_array(token, page)
    end = {int(p): int(np.flatnonzero(page == p)[-1]) + 1 for p in page}
    text = {i: token[i : end[int(page[i])]].tolist() for i in range(len(page))}
    assert sorted(sa.order) == list(range(len(page)))
    # What is over comes first, ended pages by falling number.
    key = lambda i: [(1, x) for x in text[i]] + [(0, -int(page[i]))]
    assert list(sa.order) == sorted(range(len(page)), key=key)
    for k in range(1, len(page)):
        a, b = text[sa.order[k - 1]], text[sa.order[k]]
        assert sa.common[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_tokens_of_odd_markup():
    pages = ["", "x", "<p>a<b>c</b", "a < b <", "<a href='>'>t", "<!-- never ends", "<p <i>x</i>", "1<2 <P>é</P>", "<head><title>x</title><body>y", "<head>z", "<svg>open", "<p>a</p><script>x <p>found</p>", "<style>a</style >b<STYLE x>c</style\n>d", "<script>1</script x", "<scripts>t</scripts>", "a<!--->b-->c", "<!-- <script> -->x<script>'<!--'</script>y-->"]
    t = H.tokens(B.strings(pa.array(pages)))
    got = [[] for _ in pages]
    for s, e, p, tag in zip(t.start, t.end, t.page, t.tag):
        x = bytes(t.data[s:e]).decode()
        got[p].append((bool(tag), x.lower() if tag else x))
    assert got == [plain_tokens(p) for p in pages]


def test_odd_rows(spark):
    long = "<p>" + " ".join(f"u{k}" for k in range(60_000)) + "</p>"
    menu = " ".join(f"m{k}" for k in range(20))
    rows = [(1, None, None), (2, "no url", ""), (3, "http://h/", long + menu), (4, "http://h/", menu + " own"), (4, "http://h/", menu + " own"), (None, "http://h/", menu), (None, "http://h/", menu), (5, "http://other/", menu)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL + ", text string, n_runs int")
    got = sorted(((r["page_id"] or 0, r["n_words"], r["text"][:9]) for r in H.extract(df).collect()))
    assert got == [(0, 20, ""), (0, 20, ""), (1, 0, ""), (2, 0, ""), (3, 60_020, "u0 u1 u2 "), (4, 21, "own"), (5, 20, "m0 m1 m2 ")]
    assert H.extract(df.limit(0)).isEmpty()


def test_a_repeat_on_one_page_stays(spark):
    twice = " ".join(f"m{k}" for k in range(20)) + " and " + " ".join(f"m{k}" for k in range(20))
    df = spark.createDataFrame([(1, "http://h/", twice), (2, "http://h/", "other words")], DDL)
    assert {r["page_id"]: r["n_kept"] for r in H.extract(df).collect()} == {1: 41, 2: 2}


def test_other_pages_in_a_task_than_before(spark, tmp_path):
    """A task that isn't told of its pages goes through what all tasks were told."""
    batch = pa.record_batch([pa.array([5]), pa.array([0]), pa.array(["x"])], ["marker", "salt", "html"])
    asked = np.array([10, 11, 12, 13, 13], np.uint64)
    spark.createDataFrame([(0, 0, 11), (0, 3, 12), (1, 18, 13)], "units int, unit int, f long").write.partitionBy("units").parquet(str(tmp_path / "told"))
    news = H.News(str(tmp_path / "told"), 3)
    assert list(news.of(batch).knows(asked)) == [False, True, True, True, True] and list(news.known) == [12]
    own = int(H._markers(batch).view("int64")[0])
    spark.createDataFrame([(0, 3, own)], "units int, unit int, f long").write.mode("append").partitionBy("units").parquet(str(tmp_path / "told"))
    assert list(H.News(str(tmp_path / "told"), 3).of(batch).knows(asked)) == [False, False, True, False, False]
    assert not H.News(None, 3).of(batch).knows(asked).any()


@pytest.mark.parametrize("tag", ["<svg>", "<head>", "<script>", "<style>", "<!--", "</script>", "<script></", "-->"])
def test_hostile_markup_is_linear_work(tag):
    page = tag * (1_000_000 // len(tag))
    began = time.monotonic()
    H.tokens(B.strings(pa.array([page])))
    assert time.monotonic() - began < 3


def test_short_blocks_of_the_template_go(spark):
    own = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(4)]
    page = "<body><nav><ul><li><a>Home</a></li></ul></nav><p>{}</p><p>Of.</p><div>one two three four</div><p>{}</p><footer>&copy; h</footer>"
    rows = [(k, "http://h/", page.format(own[k], f"last {k}") + end) for k, end in enumerate(["</body></html>", "", "<p>more</p>"])]
    rows += [(3, "http://other/", page.format(own[3], "last 3") + "</body></html>"), (4, "http://h/", "<footer>&copy; h"), (5, "http://h/", "<p>&copy; h</p>")]
    got = {r["page_id"]: r["text"].split() for r in H.extract(spark.createDataFrame(rows, DDL), few=H.FEW).collect()}
    # A short paragraph that is alike stays; so does a block that is on no other page of its host.
    want = {k: [*own[k].split(), "Of.", "last", str(k)] for k in range(3)}
    want[2].append("more")
    want |= {3: ["Home", *own[3].split(), *"Of. one two three four last 3 © h".split()], 4: [], 5: ["©", "h"]}
    assert got == want


def test_every_footer_that_a_host_repeats_goes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    feet = {}
    for r in pages.collect():
        if m := re.search(r"<footer>(.*?)</footer>", r["html"] or "", re.S):
            host = re.match(r"https?://([^/:?#]+)", r["url"])[1].lower()
            feet.setdefault((host, m[1]), []).append(r["page_id"])
    last = {p: html.unescape(f).split() for (_, f), ps in feet.items() if len(ps) > 1 for p in ps}
    left = {r["page_id"]: " ".join(r["text"].split()) for r in Q.op10_html(spark, "/root/testdata/sf0.1").collect()}
    assert len(last) > 1000
    assert not [p for p, f in last.items() if " ".join(f[:2]) in left[p]]  # each begins with the sign of copyright and its host
