"""Personal data by a skip-chain conditional random field.

Tokens are runs of letters, digits and ``@ . _ + -``; those with a digit or an ``@``, long ones and those that a word for
a secret assigns (``password: ...``) are nodes, all others are observed to be outside. Neighbouring nodes share a transition potential. Over any distance, each node also
shares a potential with the next equal token and with the next token of the same shape in its document,
so that a clear mention settles the unclear ones. Loopy max-product message passing finds the labels of
the whole document (Sutton and McCallum, 2004). The weights maximise the likelihood of the labels of generated text,
with the expectations that loopy sum-product gives.
"""

from __future__ import annotations

import random
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .shared import fresh, others, q

LABELS = ["O", "EMAIL", "IP", "SECRET", "B-CARD", "I-CARD", "B-PHONE", "I-PHONE", "B-ID", "I-ID"]
K = len(LABELS)
NUMBER = {name: k for k, name in enumerate(LABELS)}
#: Rounds in which all messages are sent; after these, those that still change are.
ROUNDS = 30
DAMPING = 0.3
#: A message that changes by less is settled.
SETTLED = 1e-6
#: Rounds for each node of a run of linked nodes, at most (loops may swing for ever).
PER_NODE = 4
#: Generated documents that the weights are fitted on.
GENERATED = 600
SEED = 5
#: Steps of the fit, and how far the first one goes.
STEPS = 60
RATE = 15
#: Letters and more of a token without digits that is a node for its length.
LONG = 24

TOKEN = B._table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ@._+-", high=True)
MARK = B._table(b"0123456789@")
_EDGE = b"._-"

CHAIN, SAME, LIKE = range(3)

_WORDS = {
    "password": "password passwd pwd passphrase".split(),
    "secret": "token key secret apikey api_key auth bearer credential credentials".split(),
    "phone": "phone tel call fax mobile telephone telefon".split(),
    "card": "card visa mastercard credit kreditkarte tarjeta carte".split(),
    "ip": "ip host address server addr".split(),
    "id": "ssn iban passport id social account konto".split(),
    "plain": "version release chapter section page commit sha revision order invoice item build license".split(),
}
_OF_WORD = {w: f"after {k}" for k, ws in _WORDS.items() for w in ws}

_SHAPES = [
    ("email", re.compile(r"[^@]+@[^@.]+(\.[^@.]+)*\.[a-z]{2,}")),
    ("at", re.compile(r".*@.*")),
    ("ip", re.compile(r"(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}")),
    ("decimal", re.compile(r"\d+\.\d+")),
    ("dotted", re.compile(r"\d+(\.\d+){2,}")),
    ("date", re.compile(r"\d{4}-\d\d-\d\d|\d\d?[.-]\d\d?[.-]\d{4}")),
    ("d1-2", re.compile(r"\d{1,2}")),
    ("d3", re.compile(r"\d{3}")),
    ("d4", re.compile(r"\d{4}")),
    ("d5-8", re.compile(r"\d{5,8}")),
    ("d9-12", re.compile(r"\d{9,12}")),
    ("d13-19", re.compile(r"\d{13,19}")),
    ("d20", re.compile(r"\d{20,}")),
    ("plus", re.compile(r"\+\d{1,3}")),
    ("plus long", re.compile(r"\+\d[\d-]{6,}")),
    ("local phone", re.compile(r"\d{3}-\d{4}|\d{4}-\d{4}")),
    ("long phone", re.compile(r"\d{3}[.-]\d{3}[.-]\d{4}")),
    ("grouped card", re.compile(r"\d{4}-\d{4}-\d{4}-\d{4}")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}")),
    ("iban", re.compile(r"[a-z]{2}\d{2}[a-z0-9]{11,30}")),
    ("iban start", re.compile(r"[a-z]{2}\d{2}")),
    ("hex", re.compile(r"(?=.*[a-f])(?=.*\d)[0-9a-f]{24,}")),
    ("mixed long", re.compile(r"(?=.*[a-z])(?=.*\d)[a-z0-9_-]{16,}")),
    ("mixed short", re.compile(r"(?=.*[a-z])(?=.*\d)[a-z0-9_.-]{2,15}")),
    ("prefixed", re.compile(r"(sk|pk|ghp|gho|xox[bp]|akia|glpat)[a-z0-9_-]{12,}")),
    ("letters", re.compile(r"[^\W\d_]{1,15}")),
    ("long letters", re.compile(r"[^\W\d_]{16,}")),
    ("epoch", re.compile(r"1\d{9}(\d{3})?")),
    ("hextet", re.compile(r"[0-9a-f]{1,4}")),
]
FEATURES = ["always"] + [n for n, _ in _SHAPES] + ["no shape", "luhn", "isbn", "assigned secret", "between colons", "after =", "after :", "quoted", "in brackets", "line start", "joined before", "joined after", "both long"] + sorted(set(_OF_WORD.values())) + ["after word"]
_F = {name: k for k, name in enumerate(FEATURES)}


@lru_cache(1 << 16)
def _shape_features(token: str) -> tuple[int, ...]:
    got = [_F[n] for n, r in _SHAPES if r.fullmatch(token)]
    if not got:
        got = [_F["no shape"]]
    if token.isdecimal() and token.isascii() and 13 <= len(token) <= 19:
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(token)))
        if total % 10 == 0:
            got.append(_F["luhn"])
        if len(token) == 13 and token[:3] in ("978", "979") and sum(int(c) * (1, 3)[k % 2] for k, c in enumerate(token)) % 10 == 0:
            got.append(_F["isbn"])
    return (0, *got)


def _like(token: str) -> str:
    """The form that similar tokens share."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", token)) + ("" if len(token) < 12 else " long")


@dataclass
class Nodes:
    """Nodes of a run of texts: their row, their bytes from .. to .., feature numbers, and edges (i, j, kind)."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: list[tuple[int, ...]]
    edges: np.ndarray


def nodes(column: pa.LargeStringArray) -> Nodes:
    data, offsets = B.buffers(column)
    start, end, row = B.runs(TOKEN, data, offsets)
    marks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(MARK[data], out=marks[1:], dtype=np.int32)
    assigned = _assigned(data, start, end, row)
    at = np.flatnonzero((marks[end] > marks[start]) | (end - start >= LONG) | assigned)
    raw = data.tobytes() if len(at) else b""
    begins, ends, tokens, features = [], [], [], []
    kept = []
    for t in at:
        i, j = int(start[t]), int(end[t])
        piece = raw[i:j]
        i += len(piece) - len(piece.lstrip(_EDGE))
        j -= len(piece) - len(piece.rstrip(_EDGE))
        kept.append(t)
        begins.append(i)
        ends.append(j)
        tokens.append(raw[i:j].decode("utf-8", "replace").lower())
    del raw
    begins, ends, kept = np.array(begins, np.int64), np.array(ends, np.int64), np.array(kept, np.int64)
    rows = row[kept] if len(kept) else np.zeros(0, np.int64)
    edges = []
    same: dict[tuple, int] = {}
    like: dict[tuple, int] = {}
    whole = data
    for n, (t, token) in enumerate(zip(kept, tokens)):
        r = int(rows[n])
        f = list(_shape_features(token))
        low = int(end[t - 1]) if t and row[t - 1] == r else int(offsets[r])
        gap = whole[low : begins[n]].tobytes() if begins[n] - low < 64 else whole[begins[n] - 64 : begins[n]].tobytes()
        before = whole[max(start[t - 1], end[t - 1] - 16) : end[t - 1]].tobytes().decode("utf-8", "ignore").lower().strip("._-") if t and row[t - 1] == r and begins[n] - low <= 4 else ""
        if assigned[t]:
            f.append(_F["assigned secret"])
        if gap[-1:] == b":" and whole[ends[n] : ends[n] + 1].tobytes() == b":":
            f.append(_F["between colons"])
        if b"=" in gap:
            f.append(_F["after ="])
        if b":" in gap:
            f.append(_F["after :"])
        if gap[-1:] in b"\"'`" and gap:
            f.append(_F["quoted"])
        if gap[-1:] == b"(":
            f.append(_F["in brackets"])
        if b"\n" in gap or low == offsets[r] and not before:
            f.append(_F["line start"])
        if before:
            f.append(_F[_OF_WORD.get(before, "after word")])
        features.append(f)
        if n and rows[n - 1] == r and kept[n - 1] == t - 1 and len(gap) <= 3 and b"\n" not in gap:
            edges.append((n - 1, n, CHAIN))
            f.append(_F["joined before"])
            features[n - 1].append(_F["joined after"])
            if min(len(token), len(tokens[n - 1])) >= 10:
                f.append(_F["both long"])
        m = same.get((r, token))
        if m is not None:
            edges.append((m, n, SAME))
        same[r, token] = n
        form = (r, _like(token))
        m = like.get(form)
        if m is not None and tokens[m] != token and not (m == n - 1 and _F["joined before"] in f):
            edges.append((m, n, LIKE))
        like[form] = n
    return Nodes(rows, begins, ends, [tuple(f) for f in features], np.array(edges, np.int64).reshape(-1, 3))


@lru_cache(1)
def _secret_words() -> np.ndarray:
    words = sorted({w.replace("_", sep) for w in _WORDS["password"] + _WORDS["secret"] for sep in "_-"} - {"auth", "bearer"})
    raw, size = "".join(words).encode(), np.array([len(w) for w in words])
    ends = np.cumsum(size)
    return np.sort(B.hashes(np.frombuffer(raw, np.uint8), ends - size, ends))


def _assigned(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Tokens that follow a word for a secret with a colon or an equals sign, and spaces and a quote at most, between."""
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    near = np.flatnonzero((row[1:] == row[:-1]) & (start[1:] - end[:-1] <= 4))
    sign = np.zeros(len(near), bool)
    for k in range(4):
        at = np.minimum(end[near] + k, len(data) - 1)
        sign |= (end[near] + k < start[near + 1]) & ((data[at] == 58) | (data[at] == 61))
    near = near[sign]
    known = _secret_words()
    h = B.hashes(B.LOWER[data], start[near], end[near])
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    out[near[known[place] == h] + 1] = True
    return out


@dataclass
class Weights:
    unary: np.ndarray  # features x labels
    pair: np.ndarray  # kinds x labels x labels


def unaries(w: Weights, features: Sequence[tuple[int, ...]]) -> np.ndarray:
    if not features:
        return np.zeros((0, K))
    size = np.array([len(f) for f in features])
    flat = np.fromiter((x for f in features for x in f), np.int64, int(size.sum()))
    return np.add.reduceat(w.unary[flat], np.cumsum(size) - size, axis=0)


def infer(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | None = None, damping: float = DAMPING) -> np.ndarray:
    """Labels by loopy max-product message passing; exact where the edges make no loop. Ties go to the lower label.

    Messages are passed until none changes, so that evidence gets as far as it is strong enough to, or for a number of ``rounds``.
    Where loops keep them from settling, a bound that grows with the nodes that are linked ends it.
    """
    if not len(edges):
        return unary.argmax(1)
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    kind = edges[:, 2]
    psi = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(src), K))
    linked, place = np.unique(dst, return_inverse=True)
    where = np.zeros(len(unary), np.int64)
    where[linked] = np.arange(len(linked))
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(len(linked)))
    belief = unary[linked]
    moved = np.zeros(len(src))
    for _ in range(ROUNDS if rounds is None else rounds):
        new = (psi + (belief[where[src]] - message[back])[:, :, None]).max(1)
        new -= new.max(1, keepdims=True)
        new = damping * message + (1 - damping) * new
        moved = np.abs(new - message).max(1)
        message = new
        belief = unary[linked] + np.add.reduceat(message[order], cuts, axis=0)
        if rounds is None and moved.max() <= SETTLED:
            break
    if rounds is None and moved.max() > SETTLED:
        most = ROUNDS + PER_NODE * _run_sizes(len(unary), edges)[src]
        stops = np.append(cuts[1:], len(order))

        def into(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The edges into some of the linked nodes, one node's after the other's, and where each node's begin."""
            size = stops[at] - cuts[at]
            begin = np.cumsum(size) - size
            return order[np.arange(size.sum()) + np.repeat(cuts[at] - begin, size)], begin

        changed, done = np.flatnonzero(moved > SETTLED), ROUNDS
        while len(changed):
            done += 1
            # A message follows from those into its source; one that moved has, being damped, some way to go.
            e = np.unique(np.concatenate([changed, back[into(np.unique(place[changed]))[0]]]))
            e = e[most[e] >= done]
            new = (psi[e] + (belief[where[src[e]]] - message[back[e]])[:, :, None]).max(1)
            new -= new.max(1, keepdims=True)
            new = damping * message[e] + (1 - damping) * new
            changed = e[np.abs(new - message[e]).max(1) > SETTLED]
            message[e] = new
            if len(e):
                at = np.unique(place[e])
                these, begin = into(at)
                belief[at] = unary[linked[at]] + np.add.reduceat(message[these], begin, axis=0)
    out = unary.argmax(1)
    out[linked] = belief.argmax(1)
    return out


def _run_sizes(n: int, edges: np.ndarray) -> np.ndarray:
    """For each of n nodes, how many nodes there are in its run: no edge leads from one run to another."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, edges[:, :2].min(1) + 1, 1)
    np.add.at(depth, edges[:, :2].max(1) + 1, -1)
    run = np.cumsum(np.cumsum(depth[:n]) == 0) - 1
    return np.bincount(run)[run]


# Generated text, with its labels.

_COMMON = [w for ws in _WORDS.values() for w in ws]
_SYLLABLES = "th he in er an re nd on en at ou ed ha to or it is hi es ng tion ble ing ly st sh ci ar os do men la de ch un ge ver".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _hex(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def _mention(r: random.Random) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """A mention as (text, label) parts, and the parts that a later bare mention has."""
    kind = r.choice(["email", "ip", "token", "token", "key", "card", "card", "cards", "card4", "phone", "phone", "phone2", "phone3", "ssn", "iban", "year", "version", "number", "date", "sha", "dotted", "order", "price", "code", "list", "plain secret", "prose", "isbn", "epoch", "ipv6", "phone4", "long word"])
    s = lambda x: (x, "O")
    if kind == "email":
        m = [(f"{_word(r)}{r.choice(['.', '', '_', '-'])}{_digits(r, r.randint(0, 3))}@{_word(r)}{r.choice(['', _digits(r, 1)])}.{r.choice(['mail.', ''])}{r.choice(['com', 'org', 'net', 'de', 'io'])}", "EMAIL")]
        return r.choice([[], [], [s("mail: ")]]) + m, m
    if kind == "ip":
        m = [(".".join(str(r.randint(1, 255)) for _ in range(4)), "IP")]
        return r.choice([[], [], [s("host ")], [s("address: ")]]) + m, m
    if kind == "token":
        m = [(_hex(r, r.choice([32, 40, 40, 64])), "SECRET")]
        quote = r.choice(["", "'", '"'])
        return r.choice([[s(r.choice(["token", "secret", "password", "api_key", "key"]) + r.choice([" = ", "=", ": "]) + quote), *m, s(quote)], m]), m
    if kind == "key":
        m = [(r.choice(["sk_live_", "AKIA", "ghp_", "pk_test_"]) + "".join(r.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMN23456789") for _ in range(24)) + "7a", "SECRET")]
        return r.choice([[s("key="), *m], m]), m
    if kind == "card":
        m = [(_digits(r, r.choice([16, 16, 16, 15])), "B-CARD")]
        return r.choice([[], [], [], [s("card ")]]) + m, m
    if kind == "cards":
        m = [(_digits(r, 16), "B-CARD")]
        for _ in range(r.randint(1, 4)):
            m += [s(" "), (_digits(r, 16), "B-CARD") if r.random() < 0.7 else m[0]]
        return m, m
    if kind == "card4":
        if r.random() < 0.4:
            m = [("-".join(_digits(r, 4) for _ in range(4)), "B-CARD")]
        else:
            m = [(_digits(r, 4), "B-CARD")]
            for _ in range(3):
                m += [s(" "), (_digits(r, 4), "I-CARD")]
        return r.choice([[], [s("card: ")]]) + m, m
    if kind == "phone":
        m = [(f"+{r.choice(['1', '1', '44', '49'])}", "B-PHONE"), s(" ("), (_digits(r, 3), "I-PHONE"), s(") "), (f"{_digits(r, 3)}-{_digits(r, 4)}", "I-PHONE")]
        return m, m
    if kind == "phone2":
        m = [(f"{_digits(r, 3)}-{_digits(r, 3)}-{_digits(r, 4)}", "B-PHONE")] if r.random() < 0.5 else [(f"+{_digits(r, 11)}", "B-PHONE")]
        return r.choice([[], [s("tel: ")]]) + m, m
    if kind == "phone3":
        m = [(f"+{r.choice(['33', '49', '34'])}", "B-PHONE")]
        for _ in range(r.randint(2, 4)):
            m += [s(" "), (_digits(r, r.choice([2, 3, 3, 4])), "I-PHONE")]
        return m, m
    if kind == "ssn":
        m = [(f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", "B-ID")]
        return r.choice([[], [s("SSN ")]]) + m, m
    if kind == "iban":
        if r.random() < 0.5:
            m = [(f"{r.choice(['DE', 'FR', 'ES'])}{_digits(r, 20)}", "B-ID")]
        else:
            m = [(f"{r.choice(['DE', 'FR', 'ES'])}{_digits(r, 2)}", "B-ID")]
            for _ in range(4):
                m += [s(" "), (_digits(r, 4), "I-ID")]
        return r.choice([[], [s("IBAN ")]]) + m, m
    if kind == "plain secret":
        word = r.choice([_word(r) + _word(r), "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([12, 24, 40])))])
        m = [(word, "SECRET")]
        if r.random() < 0.5:
            return [s(r.choice(["password", "passwd", "pwd"]) + r.choice([": ", "=", " = ", ": '", '="'])), *m], m
        return [s(r.choice(["token", "api_key", "secret", "key"]) + r.choice(["=", " = ", ": '", '="'])), *m], m
    if kind == "prose":
        return [s(f"{r.choice(['token', 'key', 'secret', 'auth'])}: "), (_word(r), "O"), s(f" {_word(r)}")], []
    if kind == "isbn":
        d = r.choice(["978", "979"]) + _digits(r, 9)
        m = [(d + str(-sum(int(c) * (1, 3)[k % 2] for k, c in enumerate(d)) % 10), "O")]
        return r.choice([[], [s("ISBN ")]]) + m, m
    if kind == "epoch":
        m = [("1" + r.choice("4567") + _digits(r, 8) + r.choice(["", "000", _digits(r, 3)]), "O")]
        return r.choice([[], [s("at ")], [s("timestamp: ")]]) + m, m
    if kind == "ipv6":
        parts = [f"{r.randint(0, 65535):x}" for _ in range(8)]
        m = [(v, "IP") if k % 2 == 0 else s(":") for k, v in enumerate(x for p in parts for x in (p, ":"))][:-1]
        return r.choice([[], [s("host ")]]) + m, m
    if kind == "phone4":
        m = [(_digits(r, r.choice([3, 4])), "B-PHONE"), s(") "), (_digits(r, 4), "I-PHONE"), s(" "), (_digits(r, 4), "I-PHONE")]
        return [s("("), *m], []
    if kind == "long word":
        m = [("".join(_word(r) for _ in range(9)), "O")]
        return m, m
    if kind == "sha":
        m = [(_hex(r, 40), "O")]
        return [s(r.choice(["commit ", "sha ", "revision "])), *m], m
    if kind == "dotted":
        m = [(".".join(_digits(r, 1) for _ in range(r.choice([3, 4]))), "O")]
        return [s(r.choice(["version ", "release ", "section ", "v "])), *m], m
    plain = {"year": str(r.randint(1800, 2100)), "version": f"{r.randint(1, 9)}.{r.randint(0, 12)}", "number": _digits(r, r.randint(1, 9)).lstrip("0") or "7", "date": f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", "order": _digits(r, r.randint(5, 12)), "price": f"{r.randint(1, 999)}.{_digits(r, 2)}", "code": r.choice([f"{_word(r)}{_digits(r, 2)}", f"b{_digits(r, 2)}-{_word(r)}", "h2o", "3rd", "mp3"]), "list": " ".join(_digits(r, r.randint(1, 4)) for _ in range(r.randint(2, 6)))}[kind]
    lead = {"year": ["in ", "since ", ""], "version": ["version ", "Version ", "v ", "GPL ", "CC "], "order": ["order ", "invoice ", "no. "], "number": ["", "page ", "item "]}.get(kind, [""])
    return [s(r.choice(lead) + plain)], [s(plain)]


def generated(n: int, seed: int) -> list[list[tuple[str, str]]]:
    """Documents as lists of (text, label) parts; O parts may hold many words."""
    r = random.Random(seed)
    docs = []
    for _ in range(n):
        parts: list[tuple[str, str]] = []
        bare: list[list[tuple[str, str]]] = []
        junk = r.choice(["", "", "", "%%%", "!!", "###", " |"])
        for _ in range(r.randint(2, 9)):
            parts.append(("".join(f"{_word(r) if r.random() < 0.95 else r.choice(_COMMON)}{junk}{r.choice([' ', ' ', ' ', ', ', '. ', chr(10)])}" for _ in range(r.randint(1, 8))), "O"))
            if bare and r.random() < 0.4:
                m = r.choice(bare)
            else:
                m, again = _mention(r)
                bare.append(again)
            parts += m
            parts.append((r.choice([" ", " ", ". ", ", ", ".\n", junk + " "]), "O"))
        if r.random() < 0.15:
            parts = [(t.upper(), y) for t, y in parts]
        docs.append(parts)
    return docs


def labelled(docs: list[list[tuple[str, str]]]) -> tuple[Nodes, np.ndarray]:
    """Nodes of generated documents and their true labels."""
    text = ["".join(t for t, _ in parts) for parts in docs]
    found = nodes(B.strings(pa.array(text, pa.string())))
    offsets = np.cumsum([0] + [len(t.encode()) for t in text])
    true = np.zeros(int(offsets[-1]) + 1, np.int64)
    for d, parts in enumerate(docs):
        at = int(offsets[d])
        for t, y in parts:
            n = len(t.encode())
            if y != "O":
                true[at : at + n] = NUMBER[y]
            at += n
    # A node is what its last byte is (a word may be glued to the front of an address).
    return found, true[found.end - 1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = 6, damping: float = DAMPING) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each node's labels and of each edge's pairs of labels, by loopy sum-product; exact without loops."""
    i, j, kind = edges.T
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    k = unary.shape[1]
    unary, pair = unary.astype(np.float32), pair.astype(np.float32)
    psi = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    message = np.zeros((len(src), k), np.float32)
    order = np.argsort(dst, kind="stable")
    linked, cuts = np.unique(dst[order], return_index=True)
    belief = unary.copy()
    for _ in range(rounds if len(edges) else 0):
        new = _log_sum(psi + (belief[src] - message[back])[:, :, None], 1)
        message = np.float32(damping) * message + np.float32(1 - damping) * (new - _log_sum(new, 1)[:, None])
        belief = unary.copy()
        belief[linked] += np.add.reduceat(message[order], cuts, axis=0)
    node = np.exp(belief - _log_sum(belief, 1)[:, None])
    n = len(i)
    both = pair[kind] + (belief[i] - message[n:])[:, :, None] + (belief[j] - message[:n])[:, None, :]
    both = np.exp(both - _log_sum(both.reshape(n, -1), 1)[:, None, None]) if n else both
    return node, both


@lru_cache(4)
def fit(docs: int = GENERATED, seed: int = SEED, steps: int = STEPS) -> Weights:
    """Weights fitted on generated documents, once in a process: each node by itself first, then the whole field.

    A step moves the weights towards the truth from what the field expects, which is the gradient of the likelihood; those
    of the second half of the steps are averaged.
    """
    found, y = labelled(generated(docs, seed))
    n = len(y)
    size = np.array([len(f) for f in found.features])
    x = np.zeros((n, len(FEATURES)))
    x[np.repeat(np.arange(n), size), np.concatenate([np.array(f) for f in found.features])] = 1
    i, j, kind = found.edges.T
    w = Weights(np.zeros((len(FEATURES), K)), np.zeros((3, K, K)))
    truth = np.eye(K)[y]
    for step in range(1, 301):
        z = x @ w.unary
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w.unary -= 4 / (1 + step / 100) * (x.T @ (p - truth) / n * 4 + 1e-4 * w.unary)

    def by_kind(both: np.ndarray) -> np.ndarray:
        pair = np.stack([both[kind == k].sum(0) for k in range(3)])
        for k in (SAME, LIKE):  # these have no direction
            pair[k] = (pair[k] + pair[k].T) / 2
        return pair

    good = x.T @ truth, by_kind(truth[i][:, :, None] * truth[j][:, None, :])
    mean, taken = Weights(np.zeros_like(w.unary), np.zeros_like(w.pair)), 0
    for step in range(steps):
        node, both = marginals(x @ w.unary, found.edges, w.pair)
        rate = RATE / n / (1 + step / 20)
        w.unary += rate * (good[0] - x.T @ node - 1e-4 * n * w.unary)
        w.pair += rate * (good[1] - by_kind(both) - 1e-4 * n * w.pair)
        if step >= steps // 2:
            mean.unary += w.unary
            mean.pair += w.pair
            taken += 1
    return Weights(mean.unary / taken, mean.pair / taken)


def entities(column: pa.LargeStringArray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end and label number (without B and I: that of B) of each entity, in order."""
    found = nodes(column)
    if not len(found.row):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    y = infer(unaries(w, found.features), found.edges, w.pair)
    joined = np.zeros(len(y), bool)
    joined[found.edges[found.edges[:, 2] == CHAIN, 1]] = True
    inside = np.isin(y, [NUMBER["I-CARD"], NUMBER["I-PHONE"], NUMBER["I-ID"]])
    kind = np.where(inside, y - 1, y)
    goes_on = inside & joined
    goes_on[1:] &= kind[1:] == kind[:-1]
    goes_on[:1] = False
    first = np.flatnonzero((y > 0) & ~goes_on)
    run = np.cumsum((y > 0) & ~goes_on) - 1
    last = first.copy()
    member = np.flatnonzero(y > 0)
    np.maximum.at(last, run[member], member)
    return found.row[first], found.start[first], found.end[last], kind[first]


_ENTITY = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_ARROW = pa.struct([("text", pa.string()), ("entities", pa.list_(_ENTITY))])
_RESULT = "struct<text string, entities array<struct<label string, start int, end int>>>"


def redact_column(column: pa.Array | pa.ChunkedArray, w: Weights) -> pa.Array:
    """(text, entities) of each text that holds any, else null; offsets count characters of the text as it was."""
    out = []
    for part in B.slices(pa.record_batch([B.strings(column)], ["text"]), "text"):
        text = part.column(0)
        row, start, end, kind = entities(text, w)
        data, offsets = B.buffers(text)
        got: list[dict | None] = [None] * part.num_rows
        cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
        for r in np.unique(row):
            lo, hi = cuts[r], cuts[r + 1]
            raw = data[offsets[r] : offsets[r + 1]]
            chars = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
            s, e = start[lo:hi] - offsets[r], end[lo:hi] - offsets[r]
            names = [LABELS[k].removeprefix("B-") for k in kind[lo:hi]]
            raw, pieces, at = raw.tobytes(), [], 0
            for i, j, name in zip(s, e, names):
                pieces += [raw[at:i], f"[{name}]".encode()]
                at = j
            got[r] = {"text": b"".join([*pieces, raw[at:]]).decode(), "entities": [{"label": n, "start": int(chars[i]), "end": int(chars[j])} for n, i, j in zip(names, s, e)]}
        out.append(pa.array(got, _ARROW))
    return pa.concat_arrays(out) if out else pa.array([], _ARROW)


def _redactor(text):
    w = fit()

    @F.arrow_udf(_RESULT)
    def of(column: pa.Array) -> pa.Array:
        return redact_column(column, w)

    return of.asNondeterministic()(text)  # else a filter on the result would run it twice


def find(docs: DataFrame) -> DataFrame:
    """Documents that hold personal data: (doc_id, text, entities, n_entities), the text with ``[LABEL]`` in its place.

    ``entities`` are (label, start, end) in order, in characters of the text as it was. Labels are EMAIL, IP,
    SECRET, CARD, PHONE and ID. Null and empty texts hold none. Whole texts are read, whatever the length, and every token is judged that has a
    digit or an @, is ``LONG`` or is assigned to a word for a secret. Names of persons and postal addresses, which have no form
    of their own, aren't looked for. Rows that repeat a document give a row each; a null doc_id
    is carried. Equal scores go to the label that comes first in ``LABELS``. An empty table gives no rows;
    other columns aren't looked at.
    """
    got = docs.select(q("doc_id").cast("long").alias("doc_id"), _redactor(q("text").cast("string")).alias("r")).where("r is not null")
    return got.select("doc_id", "r.text", "r.entities", F.size("r.entities").alias("n_entities"))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data in ``text`` replaced by ``[LABEL]``; ``n_chars`` follows where it was set."""
    (name,) = fresh(docs, "redacted")
    got = docs.withColumn(name, _redactor(q("text").cast("string")))
    out = []
    for c in others(docs):
        if c.lower() == "text":
            out.append(F.coalesce(q(name)["text"], q(c)).alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(q(name).isNull() | q(c).isNull(), q(c)).otherwise(F.length(q(name)["text"])).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(q(c))
    return got.select(out)
