"""Secret scan in DataFrame functions only: fixed patterns plus sliding-window Shannon entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base scan, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A maximal run of key characters; whether it holds a digit and a letter is asked afterwards.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
#: Runs that look random and are no secret: UUIDs, counters of one repeated character, alphabets in
#: order, and documented placeholders.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(.)\1{7,}",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"(?i)example|placeholder|your_?(?:key|token)",
)
#: What a path, name or date of plain words and short numbers doesn't hold.
NO_PATH = r"[+=]|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"
#: Window length and bits per character from which a window counts as random, by character class.
CLASSES = {"hex": (20, 2.9), "alnum": (20, 3.8), "base64": (20, 3.9)}
_BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value) with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, zero: Column, op) -> Column:
    """At each place op over all earlier values, zero at the first: blocks are folded on their own, then their
    results, so that no step copies an array that grows with the text."""
    fold = lambda x: F.aggregate(x, zero, op)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))

    def inside(blocks):
        def at(block, i, total):
            return let(fold(F.slice(total, F.lit(1), i)), lambda base: F.transform(block, lambda _, j: op(base, fold(F.slice(block, F.lit(1), j)))))

        return let(F.transform(blocks, fold), lambda total: F.flatten(F.transform(blocks, lambda block, i: at(block, i, total))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), inside)).otherwise(v))


_SPAN = "struct<start:int,kind:int,end:int,hit:string>"


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start,kind,end,hit>> of all leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves alternate, so running lengths of the two
    give the positions. keep(extra) filters by group 2 of a match.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    extra = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else hits
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    rows = F.zip_with(gaps, F.arrays_zip(hits.alias("hit"), extra.alias("extra")), lambda gap, x: F.struct(gap.alias("gap"), F.char_length(x["hit"]).alias("size"), x["hit"].alias("hit"), x["extra"].alias("extra")))
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit"), x["extra"].alias("extra"))
    found = let(F.filter(rows, lambda x: x["hit"].isNotNull()), lambda r: F.zip_with(before(F.transform(r, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b), r, span))
    found = F.filter(found, lambda x: keep(x["extra"])) if keep else found
    slim = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["hit"].alias("hit")))
    return F.when(text.rlike(pattern), slim).otherwise(F.array().cast(f"array<{_SPAN}>"))


def entropy_reaches(token: Column, window: int, bits: float) -> Column:
    """Whether the Shannon entropy (bits a character) of some window of the token is at least `bits`.

    By incremental counts: a step adds the character that enters, removes the one that leaves and
    corrects the running sum of c*log2(c). A character's count is taken from the window itself, so a step
    costs the window's length, whatever the token's. After the first window that reaches it, steps are empty.
    """
    plogp = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(False).alias("hit"))

    def scan(codes):
        def step(acc, i):
            come, gone = F.get(codes, i), F.when(i >= window, F.get(codes, i - window))
            old = F.slice(codes, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))  # before the character enters
            a, b = F.size(F.filter(old, lambda c: c == come)), F.size(F.filter(old, lambda c: c == gone))
            s = acc["s"] + F.when(gone.isNull(), plogp(a + 1) - plogp(a)).when(gone == come, F.lit(0.0)).otherwise(plogp(a + 1) - plogp(a) + plogp(b - 1) - plogp(b))
            new = let(s, lambda s: F.struct(s.alias("s"), ((i >= window - 1) & (F.log2(F.lit(float(window))) - s / window >= bits - 1e-9)).alias("hit")))
            return F.when(acc["hit"], acc).otherwise(new)

        # a window of few different characters can't reach it
        some = F.size(F.array_distinct(codes)) >= 2**bits - 1e-6
        return F.when(some, F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)["hit"]).otherwise(F.lit(False))

    return let(F.transform(F.split(token, ""), F.ascii), scan)


def is_secret(token: Column) -> Column:
    """Whether the run is none of the allowed ones and some window is random for its character class."""
    allowed = token.rlike(r"[/_-]") & ~token.rlike(NO_PATH)
    for p in ALLOWED:
        allowed = allowed | token.rlike(p)
    rule = lambda name: entropy_reaches(token, *CLASSES[name])
    high = F.when(token.rlike(r"^[0-9a-fA-F]+$"), rule("hex")).when(token.rlike(r"^[A-Za-z0-9]+$"), rule("alnum")).otherwise(rule("base64"))
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & ~allowed & high


def apart(cand: Column, base: Column) -> Column:
    """The spans of cand that overlap none of base: among the base spans that start before its end, the latest
    end tells. Both are put in one order, base spans by start and the others by end."""
    mark = lambda spans, key, own: F.transform(spans, lambda x: F.struct(x[key].alias("at"), F.lit(own).alias("own"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))
    rows = F.sort_array(F.concat(mark(cand, "end", 0), mark(base, "start", 1)))
    far = lambda r: before(F.transform(r, lambda x: F.when(x["own"] == 1, x["end"]).otherwise(F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b))
    both = let(rows, lambda r: F.zip_with(r, far(r), lambda x, f: F.struct(x.alias("x"), ((x["own"] == 0) & (f <= x["start"])).alias("good"))))
    return F.transform(F.filter(both, lambda y: y["good"]), lambda y: F.struct(y["x"]["start"].alias("start"), F.lit(3).alias("kind"), y["x"]["end"].alias("end"), y["x"]["hit"].alias("hit")))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __base and __spans, arrays of (start, kind, end, hit) by start, then kind.

    __base has the fixed patterns, __spans also the high-entropy runs that overlap none of them.
    Null text counts as empty and has no spans. Work grows with the length of the text, whatever it holds.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.sort_array(F.concat(spans(t, ASSIGN, 0, lambda x: F.char_length(x) >= 12), spans(t, ACCESS, 1), spans(t, HEX, 2)))
    out = docs.withColumn("__base", base).withColumn("__cand", spans(t, CANDIDATE, 3))
    far = F.filter(F.when((F.size("__base") == 0) | (F.size("__cand") == 0), F.col("__cand")).otherwise(apart(F.col("__cand"), F.col("__base"))), lambda e: is_secret(e["hit"]))
    return out.withColumn("__spans", F.sort_array(F.concat("__base", far))).drop("__cand")


def listed(spans_col: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Repeated rows give repeated rows; a null doc_id stays null; other columns are ignored.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(F.encode(listed("__base"), "UTF-8"), 256).alias("base_sha256"), listed("__spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by [SECRET]; null text stays null. Of spans that overlap, the
    stretch that they cover together is replaced once."""
    found = find_secrets(docs)
    tail = F.array(F.struct(F.char_length("text").alias("start"), F.lit(9).alias("kind"), F.char_length("text").alias("end"), F.lit("").alias("hit")))

    def clean(chars):
        gaps = let(F.concat("__spans", tail), lambda s: F.zip_with(before(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b)), s, lambda at, x: F.struct(at.alias("from"), x["start"].alias("to"))))
        apart = F.filter(gaps, lambda g: g["to"] >= g["from"])
        return F.array_join(F.transform(apart, lambda g: F.array_join(F.slice(chars, g["from"] + 1, g["to"] - g["from"]), "")), "[SECRET]")

    some = F.col("text").isNotNull() & (F.size("__spans") > 0)
    return found.withColumn("text", F.when(some, let(F.split("text", ""), clean)).otherwise(F.col("text"))).drop("__base", "__spans")
