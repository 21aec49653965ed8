"""Mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, stored

def hash01(seed: int, *cols) -> Column:
    """A number in [0, 1) from md5, the same in any engine: 52 bits of the digest."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: DataFrame | None, temperature: float, total: float | None) -> DataFrame:
    """(__source, __cdf): for each source the Poisson distribution with its mean repetition rate.

    The rate of a source is its target weight times the wanted rows over its rows. Without weights
    the target is rows ** temperature (0: all sources alike, 1: as they are). Sources that weights
    lack, or weigh at 0 or less, get no copies. The table has a row per source and its arrays are about as
    long as the largest rate, so rates far above the thousands are no use of it.
    """
    n = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source")).agg(F.count("*").cast("double").alias("__n"))
    if weights is None:
        n = n.withColumn("__w", F.pow("__n", F.lit(temperature)))
    else:
        w = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("__w"))
        n = n.join(w.groupBy("__source").agg(F.max("__w").alias("__w")), "__source", "left").fillna(0.0, ["__w"])
    whole = Window.partitionBy(F.lit(0))  # of a row per source
    n = n.select("*", F.sum("__w").over(whole).alias("__sw"), F.sum("__n").over(whole).alias("__sn"))
    lam = F.when(F.col("__sw") > 0, F.col("__w") / F.col("__sw") * (F.lit(total) if total is not None else F.col("__sn")) / F.col("__n")).otherwise(F.lit(0.0))
    n = n.select("__source", lam.alias("__rate"))
    # P(count <= k) for k up to far in the tail, each term from the one before, in logs
    top = (F.col("__rate") + 12 * F.sqrt("__rate") + 30).cast("int")
    step = lambda acc, k: F.struct((acc["l"] + F.log(F.col("__rate")) - F.log(k.cast("double"))).alias("l"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + F.exp(acc["l"] + F.log(F.col("__rate")) - F.log(k.cast("double"))))).alias("c"))
    start = F.struct((-F.col("__rate")).alias("l"), F.array(F.exp(-F.col("__rate"))).alias("c"))
    cdf = F.when(F.col("__rate") > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["c"]).otherwise(F.array(F.lit(1.0)))
    return n.select("__source", "__rate", cdf.alias("__cdf"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, total: float | None = None, seed: int = 17) -> DataFrame:
    """docs replicated to the target weights, with `copy` (1..count) and `place`, and dealt out at random.

    A row's count is the inverse of its source's Poisson distribution at a hash of (seed, doc_id, md5 of
    text), so it depends on nothing else and a rerun of a lost task repeats it. Rows whose count is 0
    go: that is the feature. Copies are exchanged by a hash of (seed, doc_id, copy) and sorted by
    it inside each partition, which is a global shuffle. Null sources are one source of their own
    named ''; null texts and ids hash as empty; repeated rows get equal counts. Other columns
    stay, also ones named copy or place, which are replaced.
    """
    keys = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    table = if_small(stored(rates(docs, weights, temperature, total)))
    cols = [c for c in docs.columns if c not in ("copy", "place")]
    keyed = docs.select(*cols).withColumn("__k", F.coalesce(F.col("source").cast("string"), F.lit("")))
    some = keyed.join(table, keyed["__k"] == table["__source"])
    u = hash01(seed, *keys)
    count = F.size(F.filter("__cdf", lambda c: c <= F.col("__u")))
    some = some.withColumn("__u", u).withColumn("__c", count).where("__c > 0")
    out = some.select(*cols, F.explode(F.sequence(F.lit(1), F.col("__c"))).alias("copy"))
    out = out.withColumn("place", hash01(seed + 1, *keys, F.col("copy").cast("string")))
    return out.repartition("place").sortWithinPartitions("place")


ORACLE_SQL = """
WITH n AS (SELECT coalesce(source, '') AS s, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, pow(n, 0.5) AS w FROM n),
r AS (SELECT s, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM w) / n AS rate FROM w),
k AS (SELECT s, rate, unnest(range(0, (rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r),
c AS (SELECT s, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM k),
d AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
m AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, md5(coalesce(d.text, '')) AS text_md5, (SELECT count(*) FROM c WHERE c.s = coalesce(d.source, '') AND c.cdf <= d.u) AS cnt FROM d)
SELECT doc_id, source, lang, n_chars, text_md5, unnest(range(1, cnt + 1))::INTEGER AS copy FROM m WHERE cnt > 0
"""
