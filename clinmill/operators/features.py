"""Leakage-safe features: everything that is fitted is fitted on train rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import icd_chapter
from ..functions.text import char_ngrams
from ..sources.scratch import if_small, stored
from .select import quantiles

SMOOTH = 20.0


def loo_target_encode(df: DataFrame, key: str, y: str, train: Column, m: float = SMOOTH) -> DataFrame:
    """df with enc: the smoothed train mean of y in the row's group, without the row's own y on train rows.

    A null key stays null and a group unseen in train gets the prior."""
    t, v = train.cast("double"), F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    prior = df.agg(F.coalesce(F.avg(F.when(train, F.col(y))), F.lit(0.0)).alias("__prior"))
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(t * v).alias("__s"), F.sum(t).alias("__n"))
    j = df.join(g, key, "left").join(F.broadcast(prior))
    s, n = F.col("__s") - t * v, F.greatest(F.col("__n") - t, F.lit(0.0))
    return j.withColumn("enc", (s + m * F.col("__prior")) / (n + m)).drop("__s", "__n", "__prior")


def profile_features(df: DataFrame, key: str, ys: list[str], train: Column, m: float = SMOOTH) -> DataFrame:
    """Volume and smoothed leave-one-out rates of several outcomes for one entity, in one aggregation."""
    t = train.cast("double")
    v = {y: F.coalesce(F.col(y).cast("double"), F.lit(0.0)) for y in ys}
    prior = df.agg(*(F.coalesce(F.avg(F.when(train, F.col(y))), F.lit(0.0)).alias(f"__p_{y}") for y in ys))
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(t).alias("__n"), *(F.sum(t * v[y]).alias(f"__s_{y}") for y in ys))
    j = df.join(g, key, "left").join(F.broadcast(prior))
    n = F.greatest(F.col("__n") - t, F.lit(0.0))
    out = j.withColumns({f"{key}_volume": n} | {f"{key}_rate_{y}": (F.col(f"__s_{y}") - t * v[y] + m * F.col(f"__p_{y}")) / (n + m) for y in ys})
    return out.drop("__n", *(f"__s_{y}" for y in ys), *(f"__p_{y}" for y in ys))


def category_codes(df: DataFrame, col: str, train: Column) -> DataFrame:
    """df with code: rank of the level among train levels, and the number of levels for null and unseen ones."""
    lv = stored(df.where(train & F.col(col).isNotNull()).select(col).distinct().withColumn("__c", F.row_number().over(Window.orderBy(col)) - 1))
    k = lv.agg(F.count("*").cast("int").alias("__k"))
    few = if_small(lv)
    return df.join(lv if few is None else few, col, "left").join(F.broadcast(k)).withColumn("code", F.coalesce("__c", "__k")).drop("__c", "__k")


def icd_features(enc: DataFrame, icd: DataFrame, train: Column, least: int = 25, top: int = 12) -> DataFrame:
    """Tier one-hots with an absent level, confidence, score, frequent chapters, rare and unknown, top codes."""
    j = enc.join(icd, "pid", "left")
    tier = F.coalesce("tier", F.lit("absent_from_table"))
    ch = F.coalesce(icd_chapter("icd_final"), F.lit("unknown"))
    fitted = j.where(train)
    keep = sorted(r["c"] for r in fitted.groupBy(ch.alias("c")).agg(F.count("*").alias("n")).where(f"n >= {int(least)} and c <> 'unknown'").collect())  # 22 chapters at most
    codes = [r["icd_final"] for r in fitted.where("icd_final is not null").groupBy("icd_final").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "icd_final").limit(top).collect()]
    one = lambda c: c.cast("int")
    cols = {f"icd_tier_{t}": one(tier == t) for t in ("confident", "low_confidence", "no_complaint", "absent_from_table")}
    cols |= {"icd_llm_confidence": F.when(F.col("llm_confidence") == "high", 3.0).when(F.col("llm_confidence") == "medium", 2.0).when(F.col("llm_confidence") == "low", 1.0), "icd_has_code": one(F.col("icd_final").isNotNull())}
    cols |= {f"icd_ch_{c}": one(ch == c) for c in keep}
    cols |= {"icd_ch_other_rare": one(~ch.isin(*keep, "unknown")), "icd_ch_unknown": one(ch == "unknown")}
    cols |= {"icd_code_" + "".join(x if x.isalnum() else "_" for x in c.lower()): one(F.coalesce(F.col("icd_final") == c, F.lit(False))) for c in codes}
    return j.select("pid", *(v.alias(k) for k, v in cols.items()))


def numeric_block(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """Train-median imputed, standardised by population deviation (a tiny one counts as 1)."""
    med = quantiles(df.where(train), {c: [0.5] for c in cols})
    j = df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c][0]).cast("double"), F.lit(0.0)) for c in cols})
    st = j.where(train).agg(*(x for c in cols for x in (F.avg(c).alias(f"__a_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))))
    j = j.join(F.broadcast(st))
    sd = lambda c: F.when(F.col(f"__s_{c}") < 1e-9, 1.0).otherwise(F.col(f"__s_{c}"))
    return j.withColumns({c: (F.col(c) - F.col(f"__a_{c}")) / sd(c) for c in cols}).select(*df.columns)


def onehot_block(df: DataFrame, col: str, levels: list[str]) -> DataFrame:
    """One column per train level; unknown and null values are zeros."""
    return df.withColumns({f"{col}_{k}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for k, v in enumerate(levels)})


def train_levels(df: DataFrame, col: str, train: Column, most: int = 256) -> list[str]:
    return [r[0] for r in df.where(train & F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(most).collect()]


def family_table(spark, columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(columns.items()), "column string, family string")


def mutual_information(df: DataFrame, feats: list[str], y: str, bins: int = 16) -> DataFrame:
    """(feature, mi) in nats: quantile bins, missing values a bin of their own."""
    edges = quantiles(df, {c: [k / bins for k in range(1, bins)] for c in feats})
    j = df.select(y, *(F.col(c).cast("double").alias(c) for c in feats))

    def binned(c: str) -> Column:
        cuts = F.array(*(F.lit(x) for x in sorted({x for x in edges[c] if x is not None}))).cast("array<double>")
        below = F.size(F.filter(cuts, lambda x: x <= F.col(c)))
        return F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNull(), bins + 1).otherwise(below).alias("b"))

    b = j.select(F.col(y).cast("string").alias("y"), F.explode(F.array(*(binned(c) for c in feats))).alias("x")).select("y", "x.*")
    n = b.groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    w = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    t = n.withColumns({"nb": w("b"), "ny": w("y"), "nn": w()})
    return t.groupBy("feature").agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nb") * F.col("ny")))).alias("mi"))


def tfidf_fit(terms: DataFrame, min_df: int = 1, most: int | None = None) -> DataFrame:
    """(term, idf) from train (row_id, term): idf = ln((1 + n) / (1 + df)) + 1."""
    n = terms.agg(F.countDistinct("row_id").alias("__n"))
    d = terms.distinct().groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    d = d.orderBy(F.desc("df"), "term").limit(most) if most else d
    return d.join(F.broadcast(n)).select("term", (F.log((1 + F.col("__n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_transform(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """(row_id, term, w): sublinear term frequency times idf, each row of length 1."""
    t = terms.groupBy("row_id", "term").agg(F.count("*").alias("tf")).join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return t.select("row_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))).alias("w"))


def char_terms(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    return df.select(F.col(key).alias("row_id"), F.explode(tokens).alias("tok")).select("row_id", F.explode(char_ngrams("tok")).alias("term"))


def svd_fit(weights: DataFrame, k: int, most: int = 50_000, extra: int = 10, rounds: int = 60, close: float = 1e-7, seed: int = 0):
    """(singular values, terms x k right vectors by term) of the (row_id, term, w) matrix, by subspace iteration.

    A round multiplies by the matrix and its transpose: each task holds k + extra columns over the terms, which are
    bounded by `most` (the commonest terms stay, as the vectoriser's limit on features), and sums per term meet in a
    shuffle. Rows of a task that agree are one row that weighs as many (passes.packed). Rounds end when the values settle,
    at the latest after `rounds`."""
    import numpy as np

    from .passes import opened, packed, summed

    terms = weights.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most).select("term").toPandas()["term"].tolist()
    index = weights.sparkSession.createDataFrame(list(enumerate(terms)), "idx int, term string")
    flat = weights.join(F.broadcast(index), "term").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("w").cast("double").alias("w")))).alias("x"))
    rows, _ = packed(flat.select(F.lit(len(terms)).alias("xn"), F.col("x.idx").alias("xi"), F.col("x.w").alias("xv"), F.array().cast("array<double>").alias("y"), F.lit(1.0).alias("n")))
    p = min(k + extra, len(terms))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), p)))[0]
    was = np.zeros(0)
    for _ in range(rounds):

        def product(pdf, q=q):
            z = np.zeros((len(terms) + 1, p))
            for x, _, _, n in opened(pdf, len(terms)):
                z += x.tdot(n[:, None] * x.dot(np.vstack([q, np.zeros(p)])))
            return z[:-1].ravel()

        z = summed(rows, product, q.size).reshape(q.shape)
        q, r = np.linalg.qr(z)
        # of A'A on the subspace: the triangle's singular values are squares of the matrix's
        u, d, _v = np.linalg.svd(r)
        q, now = q @ u, np.sqrt(d[:k])
        if len(was) == len(now) and np.abs(now - was).max() <= close * max(now.max(), 1e-300):
            break
        was = now
    return now, dict(zip(terms, q[:, :k], strict=True))


def tier(score: Column, no_complaint: Column, least: float = 0.50) -> Column:
    return F.when(no_complaint, "no_complaint").when(score >= least, "confident").otherwise("low_confidence")


def finalise(codes: Column, candidates: Column, retrieved: Column, tier_col: Column) -> Column:
    """The adjudicator's first code that is among the candidates, else the retrieved one if confident."""
    ok = F.array_intersect(codes, candidates)
    return F.when(F.size(ok) > 0, F.get(ok, F.lit(0))).when(tier_col == "confident", retrieved)


def reference_codes(df: DataFrame, code: str, drop: str = "^[V-Y]", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Three-character codes, without external causes and excluded ones, each once."""
    c = df.withColumn(code, F.left(F.upper(F.trim(code)), F.lit(3))).where(F.col(code).rlike("^[A-Z][0-9]{2}$") & ~F.col(code).rlike(drop))
    return (c.where(~F.col(code).isin(*exclude)) if exclude else c).dropDuplicates([code])
