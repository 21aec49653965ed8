"""Drift between eras."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocab_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two vocabularies, their intersection, union, what is new, and their Jaccard."""
    c = a.columns[0]
    j = a.distinct().withColumn("__a", F.lit(1)).join(b.distinct().withColumn("__b", F.lit(1)), c, "full_outer")
    out = j.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"), F.count("*").alias("n_any"), F.count_if(F.col("__a").isNull()).alias("n_new"))
    return out.withColumn("jaccard", F.try_divide("n_both", "n_any"))


def jsd(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence of two (key, n) tables, in bits."""
    ta, tb = a.agg(F.sum("n").alias("__ta")), b.agg(F.sum("n").alias("__tb"))
    j = a.select(key, F.col("n").alias("na")).join(b.select(key, F.col("n").alias("nb")), key, "full_outer").fillna(0, ["na", "nb"]).join(F.broadcast(ta)).join(F.broadcast(tb))
    p, q = F.col("na") / F.col("__ta"), F.col("nb") / F.col("__tb")
    m = (p + q) / 2
    kl = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return j.agg((F.sum(kl(p) + kl(q)) / 2).alias("jsd"))


def vocab_shift(a: DataFrame, b: DataFrame, label: str, top: int = 10) -> DataFrame:
    """Of rows labelled in two eras: share of b's rows with labels that a lacks, Jaccard, shared top labels."""
    n = lambda d: d.groupBy(label).agg(F.count("*").alias("n"))
    ca, cb = n(a), n(b)
    j = ca.select(label, F.col("n").alias("na")).join(cb.select(label, F.col("n").alias("nb")), label, "full_outer")
    unseen = j.agg(F.try_divide(F.sum(F.when(F.col("na").isNull(), F.col("nb"))), F.sum("nb")).alias("unseen_share"), F.try_divide(F.count_if(F.col("na").isNotNull() & F.col("nb").isNotNull()), F.count("*")).alias("jaccard"))
    best = lambda d: d.orderBy(F.desc("n"), label).limit(top).select(label)
    return unseen.fillna(0.0, ["unseen_share"]).join(F.broadcast(best(ca).join(best(cb), label).agg(F.count("*").alias("top_shared"))))


def entity_turnover(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Entities of b that a lacks, as a share of entities and of rows."""
    n = b.groupBy(key).agg(F.count("*").alias("n")).join(a.select(key).distinct().withColumn("__o", F.lit(1)), key, "left")
    return n.agg(F.count("*").alias("n_entities"), F.count_if(F.col("__o").isNull()).alias("n_new"), F.try_divide(F.sum(F.when(F.col("__o").isNull(), F.col("n")).otherwise(0)), F.sum("n")).alias("new_row_share"))


def empty_rate(enc: DataFrame, rx: DataFrame, key: str, by: str) -> DataFrame:
    j = enc.select(key, by).join(rx.select(key).distinct().withColumn("__x", F.lit(1)), key, "left")
    return j.groupBy(by).agg(F.avg(F.col("__x").isNull().cast("double")).alias("empty_rate"))


def label_shift(train: DataFrame, test: DataFrame, key: str, label: str) -> DataFrame:
    """Jaccard of the label spaces, share of test positives unseen in train, share of test rows touched."""
    seen = train.select(label).distinct().withColumn("__s", F.lit(1))
    t = test.select(key, label).distinct().join(seen, label, "left")
    rows = t.groupBy(key).agg(F.max(F.col("__s").isNull().cast("int")).alias("hit")).agg(F.avg("hit").alias("rows_touched"))
    pos = t.agg(F.avg(F.col("__s").isNull().cast("double")).alias("unseen_positives"))
    over = vocab_overlap(train.select(label), test.select(label)).select("jaccard")
    return pos.join(F.broadcast(rows)).join(F.broadcast(over))
