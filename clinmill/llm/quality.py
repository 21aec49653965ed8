"""Quality rules in DataFrame functions only: fixed rules, then robust multivariate outliers by MCD."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, stored
from .secrets import let

WHITE = " \t\n\x0b\x0c\r"
#: Transformed statistics and the standard deviation that each is given besides its own spread, so that
#: a statistic that is constant in a group (no symbols at all) does not reject its first exception.
AXES = {"x_len": 0.30, "x_word": 0.08, "x_types": 0.35, "x_symbols": 0.35, "x_upper": 0.35}
GRID = 64.0
#: Statistics are rounded to multiples of 1 / UNITS; distance classes are so many for each e-fold.
UNITS, CLASSES = 1024.0, 64


def words(text: Column) -> Column:
    t = F.btrim(text, F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more: windows are hashed and sorted with their
    positions, equal neighbours mark repeated windows, and gaps between positions give the cover."""

    def cover(p):
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(n), x - acc["last"])).alias("n"))
        return F.aggregate(p, F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n")), step)["n"]

    def positions(z):
        before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice(z, 1, F.size(z) - 1), lambda x: x["h"]))
        after = F.concat(F.slice(F.transform(z, lambda x: x["h"]), 2, F.size(z)), F.array(F.lit(None).cast("bigint")))
        flags = F.zip_with(F.zip_with(z, before, lambda x, b: F.struct(x["h"].alias("h"), x["i"].alias("i"), x["h"].eqNullSafe(b).alias("t"))), after, lambda x, a: F.struct(x["i"].alias("i"), (x["t"] | x["h"].eqNullSafe(a)).alias("t")))
        return F.array_sort(F.transform(F.filter(flags, lambda x: x["t"]), lambda x: x["i"]))

    def of(h):
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        some = let(F.sort_array(pairs), lambda z: cover(positions(z)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(some)

    hashes = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - n), lambda i: F.xxhash64(*(F.get(v, i + k) for k in range(n))))
    return let(w, lambda v: F.when(F.size(v) < n + 1, F.lit(0)).otherwise(let(hashes(v), of)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the transformed statistics, one row per row of docs."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", t.alias("__t"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    per_word = let(words(F.col("__t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("types"), repeated_words(w).cast("long").alias("rep")))
    out = base.select(
        "doc_id",
        "lang",
        "source",
        F.char_length("__t").cast("long").alias("__chars"),
        per_word.alias("__w"),
        F.char_length(F.translate("__t", WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.char_length("__t") - F.char_length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("__upper"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    out = out.select("doc_id", "lang", "source", F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("__w.rep").alias("n_repeat_words"), "__upper", F.col("__w.types").alias("__types"))
    n, c = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.log1p("n_words").alias("x_len"),
        F.log(c / n).alias("x_word"),
        # share of types against what the length lets expect
        F.log((F.col("__types") + 1) / F.pow(n, F.lit(0.8))).alias("x_types"),
        F.log(0.02 + F.col("n_symbols") / c).alias("x_symbols"),
        F.log(0.02 + F.col("__upper") / c).alias("x_upper"),
    )


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(dof / 2, mid / 2) < p else (lo, mid)
    return hi


def factors(params: DataFrame) -> DataFrame:
    """params (g, m0.., c00..) with l00.., the Cholesky factor of the covariance, and det, its determinant."""
    d = len(AXES)
    for i in range(d):  # one column per factor entry, so that each is computed once
        for j in range(i + 1):
            s = F.col(f"c{i}{j}")
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    det = F.lit(1.0)
    for i in range(d):
        det = det * F.col(f"l{i}{i}") * F.col(f"l{i}{i}")
    return params.withColumn("det", det)


def distances(vec: DataFrame, params: DataFrame, how: str = "left", small=if_small) -> DataFrame:
    """vec with d2, the squared distance to its group's estimate (null where there is none). small marks params for
    broadcast if their number is bounded."""
    d = len(AXES)
    out = vec.join(small(params.select("g", *(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i in range(d) for j in range(i + 1)))), "g", how)
    total = F.lit(0.0)
    for i, a in enumerate(AXES):
        s = F.col(a) - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", s / F.col(f"l{i}{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return out.select(*vec.columns, total.alias("d2"))


def mcd(vec: DataFrame, share: float = 0.75, least: int = 20, settled: float = 5e-3) -> DataFrame:
    """(g, m0.., c00.., l00.., det): minimum-covariance-determinant estimates of each group g of vec, of groups
    of at least `least` rows; the covariance is that of the chosen share of the rows, without any correction.

    The start is a coordinatewise robust distance (median and absolute deviation). Each concentration step
    takes the `share` of rows nearest to the current centre and re-estimates mean and covariance from them,
    until the determinant falls by less than `settled` of itself; groups that have settled leave the steps,
    and the estimate of the smallest determinant stays. A step sums moments by (group, distance class), so a
    group of any size meets as a few hundred partial sums; of the class in which the share ends, the part that
    fills it counts. Statistics are whole multiples of 1 / UNITS, so sums are exact whatever the partitions
    (up to 1e10 rows a group); that width squared is added to the variances, so that none is zero.
    """
    axes, d = list(AXES), len(AXES)
    cut = lambda c: F.round(c * GRID) / GRID  # noqa: E731  bounded number of values, so exact percentiles stay small
    vec = vec.select("g", *((F.round(F.col(a) * UNITS) / UNITS).alias(a) for a in axes))
    most = 20_000
    mid = stored(vec.groupBy("g").agg(*(F.percentile(cut(F.col(a)), F.lit(0.5)).alias(f"m{i}") for i, a in enumerate(axes)), F.count("*").alias("n")).where(F.col("n") >= least))
    with_mid = vec.join(if_small(mid), "g")
    mad = stored(with_mid.groupBy("g").agg(*(F.percentile(cut(F.abs(F.col(a) - F.col(f"m{i}"))), F.lit(0.5)).alias(f"s{i}") for i, a in enumerate(axes))))
    variance = lambda i: F.pow(F.greatest(1.4826 * F.col(f"s{i}"), F.lit(1 / GRID)), F.lit(2.0))
    first = mid.join(mad, "g").select("g", *(f"m{i}" for i in range(d)), *((variance(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)))
    # no later table has more groups than the first, so one count tells whether they may be broadcast
    small = F.broadcast if mid.limit(most + 1).count() <= most else (lambda table: table)
    live = stored(factors(first).withColumn("det", F.lit(float("inf"))))
    done: list[DataFrame] = []
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    unit = lambda a: F.round(F.col(a) * UNITS).cast("long")
    while not live.isEmpty():
        near = distances(vec, live, "inner", small).withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * CLASSES))
        bins = near.groupBy("g", "bin").agg(F.count("*").alias("n"), *(F.sum(unit(a)).alias(f"s{i}") for i, a in enumerate(axes)), *(F.sum(unit(axes[i]) * unit(axes[j])).alias(f"p{i}{j}") for i, j in pairs))
        order = Window.partitionBy("g").orderBy("bin")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        size = F.ceil(share * F.sum("n").over(Window.partitionBy("g")))
        part = F.greatest(F.lit(0), F.least(F.col("n"), size - before))
        some = bins.withColumn("part", part).where("part > 0")
        full = F.col("part") == F.col("n")
        sums = ["n", *(f"s{i}" for i in range(d)), *(f"p{i}{j}" for i, j in pairs)]
        # whole classes add up as whole numbers; at most one class of a group counts in part
        total = lambda c: (F.coalesce(F.sum(F.when(full, F.col(c))), F.lit(0)) + F.coalesce(F.max(F.when(~full, F.col(c) * F.col("part") / F.col("n"))), F.lit(0.0))).alias(c)
        tot = some.groupBy("g").agg(*(total(c) for c in sums))
        mean = [F.col(f"s{i}") / F.col("n") / UNITS for i in range(d)]
        cov = {(i, j): F.col(f"p{i}{j}") / F.col("n") / UNITS**2 - mean[i] * mean[j] for i, j in pairs}
        new = factors(tot.select("g", *(mean[i].alias(f"m{i}") for i in range(d)), *((cov[i, j] + (UNITS**-2.0 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs)))
        new = stored(new.join(live.select("g", F.col("det").alias("was")), "g"))
        # what has not fallen keeps the estimate before it
        done.append(new.where(F.col("det") <= F.col("was")).where(F.col("det") > (1 - settled) * F.col("was")).drop("was"))
        done.append(live.join(new.where(F.col("det") > F.col("was")).select("g"), "g", "left_semi"))
        live = new.where(F.col("det") <= (1 - settled) * F.col("was")).drop("was")
    out = done[0] if done else live
    for x in done[1:]:
        out = out.unionByName(x)
    return out


#: Rows for which the estimate of a wider group counts in that of a narrower one.
PRIOR = 100


def ready(raw: DataFrame, share: float) -> DataFrame:
    """Estimates (g, m0.., c00..) made ready for distances: the covariance of the central share of normal data is
    too small by a known factor, and each statistic gets its least spread of AXES."""
    d, axes = len(AXES), list(AXES)
    q = chi2_quantile(share, d)
    scale = share / gamma_p(d / 2 + 1, q / 2)
    return stored(factors(raw.select("g", *(f"m{i}" for i in range(d)), *((F.col(f"c{i}{j}") * scale + (AXES[axes[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)))))


def mcd_parameters(vec: DataFrame, share: float = 0.75, least: int = 20) -> DataFrame:
    return ready(mcd(vec, share, least), share)


def shrunk(vec: DataFrame, pair: DataFrame, share: float) -> DataFrame:
    """Estimates (g, m0.., c00..) of every language and source of pair (lang, source, g, n, n_lang).

    Each pair, each language and the whole table have an MCD estimate of their own, all found in the same steps. A
    language's is averaged with the table's, which counts as PRIOR rows, and a pair's with its language's in the same
    way: a pair of many rows is judged by its own, one of few mostly by its language's, without a step between.
    Under 20 rows there is no estimate to average. A pair is absent if there is none at any level."""
    wide = vec.withColumn("g", F.explode(F.array(F.concat(F.lit("s:"), "lang", F.lit("\x1f"), "source"), F.concat(F.lit("l:"), "lang"), F.lit("*"))))
    raw = stored(mcd(wide.select("g", *AXES), share))
    names = [c for c in raw.columns if c[0] in "mc"]
    of = lambda level: raw.select(F.col("g").alias(f"__{level}"), *(F.col(c).alias(f"{level}_{c}") for c in names))
    out = pair.withColumns({"__s": F.col("g"), "__l": F.concat(F.lit("l:"), "lang"), "__a": F.lit("*")})
    for level in "sla":
        out = out.join(of(level), f"__{level}", "left")

    def mean(c: str):
        table = F.col(f"a_{c}")
        lang = F.coalesce((F.col("n_lang") * F.col(f"l_{c}") + PRIOR * table) / (F.col("n_lang") + PRIOR), table)
        return F.coalesce((F.col("n") * F.col(f"s_{c}") + PRIOR * lang) / (F.col("n") + PRIOR), lang)

    return out.select("g", *(mean(c).alias(c) for c in names)).where("m0 is not null")


def quality_report(docs: DataFrame, confidence: float = 0.9999, share: float = 0.75) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, distance.

    base_failed: under 10 words, or more than a fifth of the words in repeated 5-word windows. The
    others are judged by the Mahalanobis distance of their transformed statistics to the estimate of
    their language and source (MCD of the pair, averaged by numbers of rows with that of the language and of the table;
    see shrunk), and kept up to the chi-squared quantile of `confidence`. Only rows that
    pass the base rules enter the estimates. Null text counts as empty, null lang or source as a value of its
    own; repeated rows give repeated rows; tables of under 20 such rows reject nothing. Other columns
    are ignored.
    """
    stats = statistics(docs.select("doc_id", F.col("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stored(stats.withColumn("base_failed", failed))
    good = stats.where("not base_failed")
    pair = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pair = pair.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang"))).withColumn("g", F.concat(F.lit("s:"), "lang", F.lit("\x1f"), "source"))
    pair = stored(pair)
    params = ready(shrunk(good.select("lang", "source", *AXES), pair, share), share)
    keyed = stats.withColumn("g", F.concat(F.lit("s:"), "lang", F.lit("\x1f"), "source"))
    judged = distances(keyed, params)
    limit = chi2_quantile(confidence, len(AXES))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= limit)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round(F.sqrt("d2"), 6).alias("distance"))
