"""Personal data: fixed rules, and a character BiLSTM with CRF transitions trained in numpy."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_iter_udf, over_batches, slices, stored, utf8

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base rules; found() finds their matches in time linear in the text.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters before the @ of an address.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED, SPACED, APART, NUMBER, PHONE = (re.compile(p) for p in (r"[0-9][0-9.]*", r"[0-9][0-9 -]*", r"[ -]{2,}", r"[0-9]+", RULES["phone"]))
DIGIT = re.compile("[0-9]")

#: Character classes: each sign of SIGNS its own, then digit, lower, upper, other letters, anything else.
SIGNS = "@.-+()_%,:;/ \n\"'#&*!$=|[]<>"
WINDOW, STRIDE, MARGIN, HIDDEN, TAGS = 64, 32, 16, 16, 1 + len(KINDS)
N_CLASS = len(SIGNS) + 5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in s.split("."))
    n = len(s) - sum(s.count(c) for c in " ().+-")
    return 13 <= n <= 19 and luhn("".join(DIGIT.findall(s))) if kind == "card" else 9 <= n <= 15


def _emails(text: str):
    """From each @ outwards: the characters before it back to the last match or @, the domain after it."""
    free, last, at = 0, 0, text.find("@")
    while at >= 0:
        lo = max(free, last)
        a = lo + len(text[lo:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            free = m.end()
        last, at = at + 1, text.find("@", at + 1)


def _ips(text: str):
    """Numbers joined by single dots, taken by fours from the left."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        four: list[tuple[int, int]] = []
        for m in NUMBER.finditer(text, run.start(), run.end()):
            if four and m.start() != four[-1][1] + 1:
                four = []
            four.append(m.span())
            if len(four) == 4:
                yield four[0][0], four[3][1]
                four = []


def _cards(text: str):
    """Digits with at most one blank or hyphen between two."""
    for run in SPACED.finditer(text):
        at = run.start()
        for gap in [*(m.span() for m in APART.finditer(run.group())), (run.end() - run.start(),) * 2]:
            end = run.start() + gap[0]
            b = at + len(text[at:end].rstrip(" -"))
            if b - at > 1:
                yield at, b
            at = run.start() + gap[1]


def _phones(text: str):
    return (m.span() for m in PHONE.finditer(text))


_FINDERS = {"email": ("@", _emails), "ip": (".", _ips), "card": ("", _cards), "phone": ("+", _phones)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = []
    for k, kind in enumerate(KINDS):
        sign, find = _FINDERS[kind]
        if sign in text:
            out += [(k, a, b) for a, b in find(text) if valid(kind, text[a:b])]
    return out


def _class_table() -> np.ndarray:
    t = np.full(129, len(SIGNS) + 4, np.int64)
    for k, c in enumerate(SIGNS):
        t[ord(c)] = k
    t[48:58], t[97:123], t[65:91], t[128] = len(SIGNS), len(SIGNS) + 1, len(SIGNS) + 2, len(SIGNS) + 3
    return t


CLASS = _class_table()
PAD_CLASS = N_CLASS - 1


def classes(text: str) -> np.ndarray:
    return CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def tile(cls: np.ndarray) -> np.ndarray:
    """Starts of overlapping windows that cover every digit and @, MARGIN characters around it and the words
    that these reach into, however long."""
    hot = np.flatnonzero((cls == len(SIGNS)) | (cls == 0))
    if not len(hot):
        return hot
    blank = np.flatnonzero((cls == SIGNS.index(" ")) | (cls == SIGNS.index("\n")))
    ends = np.concatenate(([-1], blank, [len(cls)]))
    lo, hi = np.maximum(hot - MARGIN, 0), np.minimum(hot + MARGIN, len(cls) - 1)
    lo = np.minimum(ends[np.searchsorted(ends, lo, "right") - 1] + 1, lo)
    hi = np.maximum(ends[np.searchsorted(ends, hi, "left")] - 1, hi)
    new = np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1))
    first = lo[new]
    last = np.maximum.reduceat(hi, np.flatnonzero(new))
    return np.concatenate([np.arange(a, max(a + 1, b + 1 - WINDOW + STRIDE), STRIDE) for a, b in zip(first, last, strict=True)])


def window_ids(cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(WINDOW)
    inside = (at >= 0) & (at < len(cls))
    return np.where(inside, cls[np.clip(at, 0, max(len(cls) - 1, 0))], PAD_CLASS)


# ---- the model ---------------------------------------------------------------------------------


@dataclass
class Model:
    wx: np.ndarray  # (2, classes, 4 hidden): input weights and bias of each direction
    wh: np.ndarray  # (2, hidden, 4 hidden)
    wo: np.ndarray  # (2 hidden + 1, tags)
    trans: np.ndarray  # (tags + 1, tags); last row: start

    @staticmethod
    def new(seed: int) -> Model:
        r = np.random.default_rng(seed)
        wx = r.normal(0, 0.3, (2, N_CLASS, 4 * HIDDEN))
        wx[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # remember at first
        return Model(wx, r.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), r.normal(0, 0.2, (2 * HIDDEN + 1, TAGS)), np.zeros((TAGS + 1, TAGS)))

    def arrays(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.wo, self.trans]


def _sig(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def emissions(m: Model, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(windows, positions, tags) scores; keep collects what the backward pass needs."""
    both = np.stack([ids, ids[:, ::-1]])
    n, t = ids.shape
    h, c = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
    out = np.empty((2, t, n, HIDDEN))
    for k in range(t):
        z = np.matmul(h, m.wh)
        z[0] += m.wx[0][both[0, :, k]]
        z[1] += m.wx[1][both[1, :, k]]
        g = _sig(z[..., : 3 * HIDDEN])
        u = np.tanh(z[..., 3 * HIDDEN :])
        i, f, o = g[..., :HIDDEN], g[..., HIDDEN : 2 * HIDDEN], g[..., 2 * HIDDEN :]
        before = (h, c)
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[:, k] = h
        if keep is not None:
            keep.append((before, i, f, o, u, tc))
    states = np.concatenate([out[0], out[1, ::-1]], -1).transpose(1, 0, 2)
    if keep is not None:
        keep.append((both, states))
    return states @ m.wo[:-1] + m.wo[-1]


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_grads(m: Model, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean CRF negative log likelihood of a window, and its gradients by forward-backward and BPTT."""
    keep: list = []
    e = emissions(m, ids, keep)
    n, t, _ = e.shape
    a = np.empty_like(e)
    a[:, 0] = m.trans[-1] + e[:, 0]
    for k in range(1, t):
        a[:, k] = _lse(a[:, k - 1, :, None] + m.trans[:-1], 1) + e[:, k]
    b = np.zeros_like(e)
    for k in range(t - 2, -1, -1):
        b[:, k] = _lse(m.trans[:-1] + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2)
    z = _lse(a[:, -1], 1)
    rows = np.arange(n)
    gold = m.trans[-1][tags[:, 0]] + e[rows, 0, tags[:, 0]]
    de = np.exp(a + b - z[:, None, None])
    dtrans = np.zeros_like(m.trans)
    dtrans[-1] = de[:, 0].sum(0)
    np.subtract.at(dtrans[-1], tags[:, 0], 1)
    for k in range(1, t):
        gold = gold + m.trans[tags[:, k - 1], tags[:, k]] + e[rows, k, tags[:, k]]
        dtrans[:-1] += np.exp(a[:, k - 1, :, None] + m.trans[:-1] + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(dtrans, (tags[:, k - 1], tags[:, k]), 1)
    de[rows[:, None], np.arange(t), tags] -= 1
    both, states = keep.pop()
    dwo = np.empty_like(m.wo)
    dwo[:-1] = np.einsum("ntd,ntk->dk", states, de)
    dwo[-1] = de.sum((0, 1))
    ds = (de @ m.wo[:-1].T).transpose(1, 0, 2)
    dh_out = np.stack([ds[..., :HIDDEN], ds[::-1, :, HIDDEN:]])
    dwx, dwh = np.zeros_like(m.wx), np.zeros_like(m.wh)
    dh, dc = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
    for k in range(t - 1, -1, -1):
        (h0, c0), i, f, o, u, tc = keep[k]
        dh = dh + dh_out[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], -1)
        dwh += np.matmul(h0.transpose(0, 2, 1), dz)
        for d in (0, 1):
            np.add.at(dwx[d], both[d, :, k], dz[d])
        dh, dc = np.matmul(dz, m.wh.transpose(0, 2, 1)), dc * f
    return float((z - gold).mean()), [g / n for g in (dwx, dwh, dwo, dtrans)]


def train(ids: np.ndarray, tags: np.ndarray, steps: int = 240, batch: int = 48, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam over hash-free, seeded batches: the same windows give the same model."""
    r, m = np.random.default_rng(seed), Model.new(seed)
    mean, var = [np.zeros_like(x) for x in m.arrays()], [np.zeros_like(x) for x in m.arrays()]
    for k in range(1, steps + 1):
        pick = r.integers(0, len(ids), batch)
        _, grads = loss_and_grads(m, ids[pick], tags[pick])
        scale = min(1.0, 5.0 / (1e-9 + np.sqrt(sum((g * g).sum() for g in grads))))
        lr = rate * min(1.0, 2.0 * (1 - k / (steps + 1)))
        for x, g, a, v in zip(m.arrays(), grads, mean, var, strict=True):
            g = g * scale
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            x -= lr * (a / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return m


def decode(m: Model, ids: np.ndarray) -> np.ndarray:
    """Best tag sequence of each window (Viterbi)."""
    e = emissions(m, ids)
    n, t, k = e.shape
    back = np.zeros((n, t, k), np.int8)
    s = m.trans[-1] + e[:, 0]
    for x in range(1, t):
        cand = s[:, :, None] + m.trans[:-1]
        back[:, x] = cand.argmax(1)
        s = cand.max(1) + e[:, x]
    out = np.empty((n, t), np.int8)
    out[:, -1] = s.argmax(1)
    rows = np.arange(n)
    for x in range(t - 1, 0, -1):
        out[:, x - 1] = back[rows, x, out[:, x]]
    return out


def reconcile(starts: np.ndarray, tags: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) over the whole text: each position takes the tag of the window in whose middle
    it lies nearest, then equal neighbours join."""
    if not len(starts):
        return []
    at = starts[:, None] + np.arange(WINDOW)
    dist = np.abs(np.arange(WINDOW) - (WINDOW - 1) / 2)
    order = np.argsort(np.broadcast_to(-dist, at.shape).ravel(), kind="stable")  # nearest to a middle last
    pos, val = at.ravel()[order], tags.ravel()[order]
    ok = (pos >= 0) & (pos < length)
    pos, val = pos[ok], val[ok]
    uniq, back = np.unique(pos, return_inverse=True)
    tag = np.zeros(len(uniq), np.int8)
    tag[back] = val
    new = np.concatenate(([True], (np.diff(uniq) > 1) | (np.diff(tag) != 0)))
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(uniq)) - 1
    return [(int(tag[i]) - 1, int(uniq[i]), int(uniq[j]) + 1) for i, j in zip(a, b, strict=True) if tag[i]]


#: ASCII signs and blanks that no span begins with (a plus and a bracket may), and what none ends with.
_NOT_FIRST = " \t\n\r!\"#$%&'*,-./:;<=>?@[\\]^_`{|}~)"
_LAST = re.compile(r"\W+\Z")


def plausible(kind: str, s: str) -> bool:
    """Exact check of what the model adds; forms that the base rules don't know are let through."""
    digits = "".join(DIGIT.findall(s))
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?@ ?[\w-]+( ?\. ?[\w-]+)+", s))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", s)
        return bool(re.fullmatch(r"[0-9]{1,3}( ?[.,] ?[0-9]{1,3}){3}", s)) and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9 ./_-]*[0-9]", s))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9( ][0-9 ()./-]*[0-9]", s)) and bool(re.search(r"[ ()./-]", s)) and not re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s)


def added(text: str, found: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the model adds: plausible spans that overlap no base span, or that hold those of their own kind
    that they overlap whole (an address whose first letters the base rules don't know)."""
    out = []
    by_start = sorted((x, y, k) for k, x, y in base)
    starts = [x for x, _, _ in by_start]
    longest = list(accumulate((y for _, y, _ in by_start), max))  # so far, by start
    for k, a, b in found:
        s = text[a:b]
        left = len(s) - len(s.lstrip(_NOT_FIRST))
        s = s[left:]
        a, s = a + left, _LAST.sub("", s)
        b = a + len(s)
        if not s or not plausible(KINDS[k], s):
            continue
        j = bisect_left(starts, b)
        ok = True
        while j and ok and longest[j - 1] > a:
            j -= 1
            x, y, own = by_start[j]
            ok = y <= a or (own == k and a <= x and y <= b and (x, y) != (a, b))
        if ok:
            out.append((k, a, b))
    return out


# ---- labelled windows ---------------------------------------------------------------------------


def _variant(kind: str, s: str, r: np.random.Generator) -> str:
    """Another way in which people write the same thing; most of them the base rules don't know."""
    digits = "".join(DIGIT.findall(s))
    by = lambda d, *n: [d[sum(n[:i]) : sum(n[: i + 1])] for i in range(len(n))]
    if kind == "email":
        at, letter = int(r.integers(0, max(1, s.find("@")))), "éèüñöçа"[int(r.integers(0, 7))]
        return (s, s.upper(), s.replace("@", " @ "), s[:at] + letter + s[at:], letter + s)[int(r.integers(0, 5))]
    if kind == "card":
        return (s, digits, *(x.join([*by(digits, 4, 4, 4), digits[12:]]) for x in " .-/"))[int(r.integers(0, 6))]
    if kind == "phone":
        a, b, c = by(digits[-10:], 3, 3, 4)
        return (s, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"00{digits[:-10]} {a} {b} {c}")[int(r.integers(0, 6))]
    return s


def _synthetic(kind: str, r: np.random.Generator) -> str:
    num = lambda n: "".join(str(x) for x in r.integers(0, 10, n))
    word = lambda: "".join(chr(97 + x) for x in r.integers(0, 26, int(r.integers(2, 9))))
    if kind == "email":
        return f"{word()}{'._'[int(r.integers(0, 2))]}{num(2)}@{word()}.{word()[:3]}"
    if kind == "ip":
        return ".".join(str(x) for x in r.integers(0, 256, 4))
    if kind == "card":
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))
    if kind == "phone":
        return f"+{int(r.integers(1, 99))} ({num(3)}) {num(3)}-{num(4)}"
    return (f"{int(r.integers(1900, 2100))}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(1)}", f"{num(5)}", f"${num(3)},{num(3)}", f"{word()}{num(3)}", f'"{"".join("0123456789abcdef"[x] for x in r.integers(0, 16, 40))}"')[int(r.integers(0, 7))]


def synthetic_text(r: np.random.Generator, least: int) -> tuple[str, list[tuple[int, int, int]]]:
    """Invented words with invented personal data and harmless numbers among them, some side by side, and
    the (kind, start, end) of the former."""
    text, spans = "", []
    while len(text) < least:
        text += "".join("abcdefghijklmnopqrstuvwxyzéèüñ"[x] for x in r.integers(0, 30, int(r.integers(1, 9)))) + " .,\n"[int(r.integers(0, 4))] + " "
        while r.random() < 0.3:
            kind = (*KINDS, "none")[int(r.integers(0, TAGS))]
            s = _variant(kind, _synthetic(kind, r), r)
            if kind != "none":
                spans.append((KINDS.index(kind), len(text), len(text) + len(s)))
            text += s + ("", "", "", ".", ",", "!!", "***")[int(r.integers(0, 7))] + " "
    return text, spans


def synthetic_windows(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of synthetic texts, so that a table without personal data still gives a model."""
    r = np.random.default_rng(seed)
    ids, tags = np.empty((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, spans = synthetic_text(r, WINDOW + 8)
        at = int(r.integers(0, max(1, len(text) - WINDOW)))
        tag = np.zeros(len(text), np.int64)
        for t, a, b in spans:
            tag[a:b] = t + 1
        ids[k], tags[k] = classes(text)[at : at + WINDOW], tag[at : at + WINDOW]
    return ids, tags


_WIDER = re.compile(r"[\w.%+-]*\Z")


def _labelled(batch):
    """Windows of each text, tagged by the base rules (an address with the letters of other alphabets that
    touch it); in every second text spans are rewritten first."""
    out: dict[str, list] = {"key": [], "ids": [], "tags": []}
    for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
        if not re.search("[0-9@]", text):
            continue
        r = np.random.default_rng(abs(key))
        spans = sorted((a - len(_WIDER.search(text[max(0, a - WINDOW) : a]).group()) if k == 0 else a, b, k) for k, a, b in base_spans(text))
        pieces, tags, at = [], [], 0
        for a, b, k in spans:
            if a < at:
                continue
            s = _variant(KINDS[k], text[a:b], r) if key % 2 else text[a:b]
            pieces += [text[at:a], s]
            tags += [np.zeros(a - at, np.int64), np.full(len(s), k + 1)]
            at = b
        new = "".join(pieces) + text[at:]
        tag = np.concatenate([*tags, np.zeros(len(text) - at, np.int64)])
        cls = classes(new)
        starts = tile(cls)
        at = starts[:, None] + np.arange(WINDOW)
        t = np.where((at >= 0) & (at < len(tag)), tag[np.clip(at, 0, len(tag) - 1)], 0)
        out["key"] += [(key * 1_000_003 + x) % (1 << 63) for x in starts.tolist()]
        out["ids"] += window_ids(cls, starts).tolist()
        out["tags"] += t.tolist()
    yield out


def fit(docs: DataFrame, most_docs: int = 3000, most_windows: int = 1500, synthetic: int = 900) -> Model:
    """A model from at most most_windows windows of at most most_docs documents, taken in hash order and
    labelled by the base rules, and from `synthetic` invented ones. Deterministic for a given table."""
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("string")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    some = docs.select("key").distinct().orderBy("key").limit(most_docs)
    rows = docs.join(F.broadcast(stored(some)), "key", "left_semi")  # at most most_docs ids
    got = over_batches(rows, lambda: _labelled, "key long, ids array<long>, tags array<long>").orderBy(F.xxhash64("key"), "key", F.xxhash64("ids")).limit(most_windows).toPandas()
    ids, tags = synthetic_windows(synthetic)
    if len(got):
        ids = np.concatenate([ids, np.array(got["ids"].tolist())])
        tags = np.concatenate([tags, np.array(got["tags"].tolist())])
    return train(ids, tags)


# ---- the operator --------------------------------------------------------------------------------


def _find(model: Model):
    """f(texts) -> [(base, added)] for a list of texts, the windows of all texts decoded together."""

    def f(texts: list[str]) -> list[tuple[list, list]]:
        cls = [classes(t) for t in texts]
        starts = [tile(c) for c in cls]
        n = np.cumsum([0, *(len(s) for s in starts)])
        ids = np.concatenate([window_ids(c, s) for c, s in zip(cls, starts, strict=True)]) if texts else np.empty((0, WINDOW), np.int64)
        tags = np.concatenate([decode(model, ids[i : i + 512]) for i in range(0, len(ids), 512)]) if len(ids) else np.empty((0, WINDOW), np.int8)
        out = []
        for k, t in enumerate(texts):
            base = base_spans(t)
            out.append((base, added(t, reconcile(starts[k], tags[n[k] : n[k + 1]], len(t)), base)))
        return out

    return f


def _batches(model: Model, make, kind: pa.DataType):
    """Batch function that makes a value of each text; works on slices, so its memory is a slice's."""

    def run(batches):
        find = _find(model)
        hot = np.zeros(256, bool)
        hot[[64, *range(48, 58)]] = True
        for col in batches:
            data, offs = utf8(col)
            done = []
            for i, j in slices(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row = np.unique(np.searchsorted(o, np.flatnonzero(hot[part]), "right") - 1).tolist()
                rows = [make("", [], [])] * (j - i) if kind != pa.string() else col.slice(i, j - i).to_pylist()
                texts = [part[o[k] : o[k + 1]].tobytes().decode("utf-8", "surrogatepass") for k in row]
                for k, t, (base, more) in zip(row, texts, find(texts), strict=True):
                    rows[k] = make(t, base, more)
                done.append(pa.array(rows, kind))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_REPORT = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _report(text, base, more) -> dict:
    return {f"n_{k}": sum(s[0] == x for s in base) for x, k in enumerate(KINDS)} | {"base_sha256": hashlib.sha256(_listed(base).encode()).hexdigest(), "spans": _listed([*base, *more]), "n_added": len(more)}


def _redacted(text, base, more) -> str:
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in [*base, *more]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def pii_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 cover the base rules, spans also what the model adds: spans that pass an
    exact check of their kind and overlap no base span, or hold one of their kind whole. Windows around
    digits and @ are decoded, with the words that they reach into, since every kind holds one of them. Null text counts as empty; repeated rows give repeated rows;
    a null doc_id stays null; other columns are ignored.
    """
    find = arrow_iter_udf(_batches(model or fit(docs), _report, _REPORT), "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return docs.select("doc_id", find(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__p")).select("doc_id", "__p.*")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars follows where docs has it. Null text
    stays null."""
    clean = arrow_iter_udf(_batches(model or fit(docs), _redacted, pa.string()), "string")
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), clean(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out
