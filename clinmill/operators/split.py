"""Splits by patient and by time, and the guards against leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import hash_rank


def temporal_split(year, train_end: int, val_end: int) -> Column:
    return F.when(year <= train_end, "train").when(year <= val_end, "val").otherwise("test")


def patient_split(enc: DataFrame, uid: str, seed: int = 42, val: float = 0.10, test: float = 0.20) -> DataFrame:
    """(uid, split): patients in order of a seeded hash; the first share is test, the next val.

    The two cut hashes are looked up from counts by hash prefix, so no task sorts all patients."""
    p = enc.select(uid).distinct().withColumn("h", hash_rank(seed, uid))
    n = p.count()
    n_test, n_val = int(n * test), int(n * val)
    cuts = []
    for want in (n_test, n_test + n_val):
        cuts.append(_nth(p, want))
    order = F.struct("h", uid)
    lit = lambda c: F.struct(F.lit(c[0]).cast("bigint").alias("h"), F.lit(c[1]).cast(dict(p.dtypes)[uid]).alias(uid))
    return p.select(uid, F.when(order <= lit(cuts[0]), "test").when(order <= lit(cuts[1]), "val").otherwise("train").alias("split"))


def _nth(p: DataFrame, n: int) -> tuple:
    """The n-th smallest (h, id): the 4096th of the hash range that holds it, then inside that range."""
    if n <= 0:
        return (-1, None)
    uid = p.columns[0]
    counts = {r["b"]: r["n"] for r in p.groupBy(F.shiftright("h", 20).alias("b")).agg(F.count("*").alias("n")).collect()}
    run = 0
    for b in sorted(counts):
        if run + counts[b] >= n:
            r = p.where(F.shiftright("h", 20) == b).orderBy("h", uid).limit(n - run).orderBy(F.desc("h"), F.desc(uid)).first()
            return (r["h"], r[uid])
        run += counts[b]
    return (1 << 40, None)


def frozen_split(enc: DataFrame, old: DataFrame, uid: str, seed: int = 42) -> DataFrame:
    """Old assignments stay; only patients without one are drawn."""
    new = patient_split(enc.join(old.select(uid), uid, "left_anti"), uid, seed)
    return old.select(uid, "split").unionByName(new)


def straddlers(enc: DataFrame, uid: str) -> DataFrame:
    """Patients in more than one split; empty if all is well."""
    return enc.groupBy(uid).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def leak_report(enc: DataFrame, key: str, year: str) -> DataFrame:
    """Per split: rows, first and last year, number of years, rows shared with another split."""
    shared = enc.select(key, "split").distinct().groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key, F.lit(1).alias("__s"))
    return enc.join(shared, key, "left").groupBy("split").agg(F.count("*").alias("n"), F.min(year).alias("first"), F.max(year).alias("last"), F.countDistinct(year).alias("n_years"), F.count("__s").alias("shared"))


def split_drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows by (old split, new split), with moved or not."""
    j = a.select(key, F.col("split").alias("old")).join(b.select(key, F.col("split").alias("new")), key)
    return j.groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("moved", F.col("old") != F.col("new"))


def split_overlap(a: DataFrame, b: DataFrame, key: str, split: str = "test") -> DataFrame:
    rows = lambda d: d.where(F.col("split") == split).select(key).distinct()
    return rows(a).join(rows(b), key).agg(F.count("*").alias("n"))
