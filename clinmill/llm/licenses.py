"""License scan: exact phrases, then fuzzy search of short notices by pigeonhole seeds and bounded edits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, HEAD, NOT_ALNUM, U, arrow_iter_udf, hash_words, slices, utf8, words

#: Fixed phrases of the base search and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices looked for within a bounded number of edits; words only, as the search sees text.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("subject to the terms of the mozilla public license", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 9
SEED = 8  # bytes of a seed that the scan compares at once
KEPT = 50_000  # windows whose result a task keeps


def edits_for(notice: str) -> int:
    return max(1, len(notice) // PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces, of which any text within the edits holds one unchanged.

    Where pieces would be shorter than SEED the number of edits is lowered until they are not."""
    k = min(edits_for(notice), len(notice) // SEED - 1) + 1
    at = [len(notice) * i // k for i in range(k + 1)]
    return [(a, notice[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def allowed(notice: str) -> int:
    return len(pieces(notice)) - 1


def normal(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, source position, row offsets): folded words of each row joined by single spaces."""
    inside = ~NOT_ALNUM[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one separator after each word
    firsts = offs[:-1][offs[1:] > offs[:-1]]
    keep[firsts] = inside[firsts]
    at = np.flatnonzero(keep)
    out = np.where(inside[at], FOLD[data[at]], np.uint8(32))
    return out, at, np.searchsorted(at, offs)


def _windows(b: np.ndarray) -> np.ndarray:
    """The SEED bytes from each position as one integer."""
    if len(b) < SEED:
        return np.empty(0, U)
    x = b.astype(U)
    for step in (1, 2, 4):
        x = x[: len(x) - step] | (x[step:] << U(8 * step))
    return x


def least_edits(masks: dict[str, int], n: int, text: str) -> int:
    """Fewest edits that turn the pattern of the bit masks into some stretch of text (bit-parallel)."""
    high, full = 1 << (n - 1), (1 << n) - 1
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & full, up & diag
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(diag | plus)) & full, plus & diag & full
        best = min(best, score)
    return best


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(hash_words(p), label) for p, label in phrases]
        self.notices = [(n, label, allowed(n), {c: sum(1 << i for i, x in enumerate(n) if x == c) for c in set(n)}) for n, label in notices]
        self.patterns: dict[tuple[str, int], regex.Pattern] = {}
        self.met: dict[tuple[int, bytes], tuple[int, int, float] | None] = {}
        self.seeds: dict[int, list[tuple[int, int, bytes]]] = {}
        for k, (n, *_) in enumerate(self.notices):
            for off, piece in pieces(n):
                raw = piece.encode()
                self.seeds.setdefault(int.from_bytes(raw[:SEED], "little"), []).append((k, off, raw))
        self.table = np.zeros(1 << 16, bool)
        self.table[self._slot(np.array(list(self.seeds), U))] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return ((x * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int64)

    def fuzzy(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """(row, label, start byte, end byte, closeness) of notices within their edits."""
        b, at, o = normal(data, offs)
        x = _windows(b)
        found: dict[tuple[int, str, int, int], float] = {}
        tried: set[tuple[int, int, int]] = set()
        for i in np.flatnonzero(self.table[self._slot(x)]).tolist():
            for k, off, raw in self.seeds.get(int(x[i]), ()):
                if b[i : i + len(raw)].tobytes() != raw:
                    continue
                row = int(np.searchsorted(o, i, "right") - 1)
                n, label, e, _ = self.notices[k]
                lo, hi = max(int(o[row]), i - off - e), min(int(o[row + 1]), i - off + len(n) + e)
                # pieces of one occurrence agree on its start but for the edits between them
                if (k, row, i - off) in tried:
                    continue
                tried.add((k, row, i - off))
                m = self.verified(k, b[lo:hi].tobytes())
                if m:
                    s, t = int(at[lo + m[0]]), int(at[lo + m[1] - 1]) + 1
                    key = (row, label, s, t)
                    found[key] = max(found.get(key, 0.0), m[2])
        return [(*k, v) for k, v in found.items()]

    def verified(self, k: int, near: bytes) -> tuple[int, int, float] | None:
        """(start, end, closeness) of notice k in a window, if it is there; a window met before is looked up."""
        if (k, near) not in self.met:
            if len(self.met) >= KEPT:
                self.met.clear()
            n, _, e, masks = self.notices[k]
            # one character a byte, so that positions stay positions
            text, got = near.decode("latin-1"), None
            # a plain bound first: bounded-error matching is slow only where it fails
            least = least_edits(masks, len(n), text)
            if least <= e:
                if (n, least) not in self.patterns:
                    self.patterns[n, least] = regex.compile(f"(?:{regex.escape(n)}){{e<={least}}}")
                m = self.patterns[n, least].search(text)
                got = (m.start(), m.end(), 1 - sum(m.fuzzy_counts) / len(n)) if m else None
            self.met[k, near] = got
        return self.met[k, near]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[dict]:
        h, row, _, _ = words(data, offs, NOT_ALNUM, FOLD)
        m = len(offs) - 1
        n = np.bincount(row, minlength=m)
        out = [{"n_words": int(c), "n_base": 0, "first_word": None, "last_word": None, "base": set(), "labels": set(), "score": 0.0, "spans": []} for c in n]
        for p, label in self.phrases:
            k = len(h) - len(p) + 1
            if k <= 0:
                continue
            hit = row[:k] == row[len(p) - 1 :]
            for x in range(len(p)):
                hit &= h[x : x + k] == p[x]
            for i in np.flatnonzero(hit).tolist():
                r, w = out[row[i]], int(i - np.searchsorted(row, row[i]))
                r["n_base"] += 1
                r["first_word"] = w if r["first_word"] is None else min(w, r["first_word"])
                r["last_word"] = w if r["last_word"] is None else max(w, r["last_word"])
                r["base"].add(label)
                r["score"] = 1.0
        fuzzy = self.fuzzy(data, offs)
        chars = np.cumsum(np.concatenate(([False], HEAD[data])), dtype=np.int64) if fuzzy else None
        for r, label, s, t, near in fuzzy:
            out[r]["labels"].add(label)
            out[r]["score"] = max(out[r]["score"], near)
            a, b = int(chars[s] - chars[offs[r]]), int(chars[t] - chars[offs[r]])
            out[r]["spans"].append((a, b, label))
        for r in out:
            r["labels"] |= r["base"]
        return out


def _run(batches):
    scan = Scanner()
    for col in batches:
        data, offs = utf8(col)
        rows = [r for i, j in slices(offs) for r in scan.scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        cols = [
            *(pa.array([r[k] for r in rows], pa.int64()) for k in names[:4]),
            *(pa.array([",".join(sorted(r[k])) for r in rows], pa.string()) for k in ("base", "labels")),
            pa.array([r["score"] for r in rows], pa.float64()),
            pa.array([",".join(f"{label}:{a}:{b}" for a, b, label in sorted(r["spans"])) for r in rows], pa.string()),
        ]
        yield pa.StructArray.from_arrays(cols, names)


def license_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score and spans (label:start:end of fuzzy notices, in code points).

    score is 1 with a base phrase, else the share of unedited characters of the closest notice, 0 without.
    Null text counts as empty; repeated rows give repeated rows; a null doc_id stays null; other
    columns are ignored.
    """
    find = arrow_iter_udf(_run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
    out = docs.select("doc_id", find(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__l"))
    return out.select("doc_id", "__l.*")
