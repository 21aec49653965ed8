"""Column expressions over notes: normalising, tokens, glossary, segmentation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CHECKUP, DURATION_TAIL, DURATION_VAGUE, GLOSSARY, NO_COMPLAINT_NOTE, NO_COMPLAINT_SPAN, SEPARATOR, SPELLING, SPELLING_EXEMPT, TOKEN, TOKEN_JOINED, TRAIL_PUNCT


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fix_mojibake(c) -> Column:
    """UTF-8 that was read as Latin-1, put right where that yields Bengali."""
    s = _c(c)
    fixed = F.try_validate_utf8(F.encode(F.when(s.rlike("^[\\x00-\\xff]*$"), s), "ISO-8859-1").cast("string"))
    return F.when(s.rlike("[àáâãäåÃÂ]") & fixed.rlike("[\\u0980-\\u09ff]"), fixed).otherwise(s)


def _nfkc():
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return nfkc


def norm_text(c, compatible: bool = False) -> Column:
    """Repaired, Bengali digits to ASCII, markup out, white space to single spaces; null gives ''.

    compatible adds NFKC, which Spark lacks: an Arrow UDF that rows of plain ASCII skip."""
    s = fix_mojibake(F.coalesce(_c(c), F.lit("")))
    if compatible:
        s = F.when(s.rlike("[^\\x00-\\x7f]"), _nfkc()(F.when(s.rlike("[^\\x00-\\x7f]"), s))).otherwise(s)
    s = F.translate(s, "০১২৩৪৫৬৭৮৯", "0123456789")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))


def tokenize(c) -> Column:
    return F.regexp_extract_all(F.lower(norm_text(c)), F.lit(TOKEN), F.lit(0))


def tokenize_joined(c) -> Column:
    return F.regexp_extract_all(F.lower(norm_text(c)), F.lit(TOKEN_JOINED), F.lit(0))


def norm_name(c) -> Column:
    """Brand key: lower, marks and outer dots, dashes and spaces off."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(_c(c), F.lit("")))), "[®™]", ""), r"\s+", " ")
    return F.regexp_replace(s, r"^[ .\-]+|[ .\-]+$", "")


def joined(value: str) -> str:
    return "_".join(re.findall("[a-z0-9]+", value.lower()))


def expand_glossary(c, mode: str = "spaced", glossary: dict[str, str] = GLOSSARY) -> Column:
    """Abbreviations written out. spaced: longest key first, one after the other, so that an expansion can
    be expanded again; joined: one pass, expansion as one token; augmented: the abbreviation
    and its token; canonical, canonical_augmented: phrases that spell an expansion out become (or get) its token too."""
    order = sorted(glossary, key=len, reverse=True)
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    if mode == "spaced":
        full = s
        for k in order:
            full = F.regexp_replace(full, f"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])", glossary[k])
        # most notes hold no key: one search spares them the chain
        some = s.rlike(f"(?<![a-z0-9])(?:{'|'.join(re.escape(k) for k in order)})(?![a-z0-9])")
        return F.trim(F.regexp_replace(F.when(some, full).otherwise(s), r"\s+", " "))
    table = F.create_map(*(F.lit(x) for k in order for x in (k, joined(glossary[k]))))
    both = mode.endswith("augmented")
    s = _mapped(s, f"(?<![a-z0-9])(?:{'|'.join(re.escape(k) for k in order)})(?![a-z0-9])", lambda x: F.concat(x, F.lit(" "), F.element_at(table, x)) if both else F.element_at(table, x))
    if mode.startswith("canonical"):
        phrases = sorted({tuple(joined(v).split("_")) for v in glossary.values() if "_" in joined(v)}, key=lambda w: -len("_".join(w)))
        for w in phrases:
            target = "_".join(w)
            s = F.regexp_replace(s, f"(?<![a-z0-9_]){'[^a-z0-9_]+'.join(w)}(?![a-z0-9_])", f"$0 {target}" if both else target)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _mapped(s: Column, pattern: str, f) -> Column:
    """s with each match replaced by f(match): gaps and matches alternate and are joined again."""
    gaps, hits = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(f(h), F.lit("")))), "")


def orthography_word(w) -> Column:
    """American spelling of one word by the first rule that changes it."""
    w = _c(w)
    out = F.when(w.isin(*SPELLING_EXEMPT), w)
    for pattern, new in SPELLING:
        out = out.when(w.rlike(pattern), F.regexp_replace(w, pattern, new))
    return out.otherwise(w)


def orthography(c) -> Column:
    return _mapped(_c(c), "[a-z]+", lambda w: orthography_word(w))


def is_no_complaint(c, variant: str = "span") -> Column:
    s = F.coalesce(_c(c), F.lit(""))
    if variant == "note":
        return F.trim(s).rlike(NO_COMPLAINT_NOTE)
    t = F.trim(s)
    core = F.regexp_replace(t, TRAIL_PUNCT, "")
    return (t != "") & (t.rlike(CHECKUP) | ((core != "") & (F.length(core) <= 40) & core.rlike(NO_COMPLAINT_SPAN)))


MARKER = r"(?:(?<=^)|(?<=[\s,;.\-]))(0?\d{1,2})\s*[.)]\s+(?!\d)"


def enumerated_chunks(c) -> Column:
    """Pieces of a note that counts 1, 2, 3...; null unless at least two markers are in order."""

    def cut(s):
        gaps = F.split(s, MARKER, -1)
        marks = F.transform(F.regexp_extract_all(s, F.lit(MARKER), F.lit(0)), lambda x: x)
        numbers = F.transform(F.regexp_extract_all(s, F.lit(MARKER), F.lit(1)), lambda x: x.cast("int"))
        start = F.struct(F.lit(1).alias("want"), F.array(F.element_at(gaps, 1)).alias("out"))
        rows = F.arrays_zip(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g"), marks.alias("m"), numbers.alias("n"))

        def step(a, x):
            ok = x["n"] == a["want"]
            last = F.concat(F.element_at(a["out"], -1), x["m"], x["g"])
            return F.struct((a["want"] + ok.cast("int")).alias("want"), F.when(ok, F.concat(a["out"], F.array(x["g"]))).otherwise(F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(last))).alias("out"))

        done = F.aggregate(rows, start, step)
        return F.when(done["want"] >= 3, F.filter(done["out"], lambda x: F.trim(x) != ""))

    return let(_c(c), cut)


def segment(c, min_chars: int = 3) -> Column:
    """Complaint spans: pieces between separators, short ones glued to the span before."""

    def cut(t):
        chunks = F.coalesce(enumerated_chunks(t), F.array(t))
        parts = F.flatten(F.transform(chunks, lambda x: F.split(x, SEPARATOR)))
        clean = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TRAIL_PUNCT, ""), r"\s+", " "))), lambda x: x != "")

        def step(a, x):
            glued = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws(" ", F.element_at(a, -1), x)))
            return F.when((F.length(x) < min_chars) & (F.size(a) > 0), glued).when(F.length(x) >= min_chars, F.concat(a, F.array(x))).otherwise(a)

        return F.when((t == "") | is_no_complaint(t), F.array().cast("array<string>")).otherwise(F.aggregate(clean, F.array().cast("array<string>"), step))

    return let(F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"\s+", " ")), cut)


def strip_duration(c) -> Column:
    s = F.regexp_replace(F.regexp_replace(_c(c), DURATION_TAIL, " "), DURATION_VAGUE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), TRAIL_PUNCT, ""))


def span_keys(spans) -> Column:
    key = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_duration(s)), "[^a-z0-9/ ]+", " "), r"\s+", " "))
    return F.filter(F.transform(_c(spans), key), lambda x: x != "")


def uni_bigrams(tokens, sep: str = "|") -> Column:
    t = _c(tokens)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.concat(t, F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(sep), b)))


def segmented_terms(spans) -> Column:
    """Terms of each span, bigrams inside spans only, and a marker for the number of spans."""
    s = _c(spans)
    terms = F.flatten(F.transform(s, lambda x: uni_bigrams(F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)))))
    return F.concat(terms, F.array(F.concat(F.lit("__n"), F.least(F.size(s), F.lit(5)).cast("string"))))


def char_ngrams(word, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams of a word padded by a space on either side."""
    w = F.concat(F.lit(" "), _c(word), F.lit(" "))

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        return F.filter(grams, lambda x: F.length(x) == n)

    return F.flatten(F.array(*(of(n) for n in range(lo, hi + 1))))
