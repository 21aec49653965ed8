"""Seeded samples by hash rank: the same rows in any engine and at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import hash_rank


def stratified_sample(df: DataFrame, stratum: str, key: str, quota: dict[str, int], default: int, seed: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(hash_rank(seed, key), key)
    limit = F.lit(default)
    for k, n in quota.items():
        limit = F.when(F.col(stratum) == k, n).otherwise(limit)
    most = max([default, *quota.values()])
    # a constant bound on the rank lets Spark drop rows before the exchange
    return df.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= most) & (F.col("__r") <= limit)).drop("__r")


def pairwise_sample(enc: DataFrame, rx: DataFrame, key: str, n_empty: int, n_filled: int, seed: int) -> DataFrame:
    """A quota of encounters without drugs and one of those with drugs."""
    e = enc.select(key).join(rx.select(key).distinct().withColumn("__rx", F.lit(1)), key, "left").select(key, F.coalesce("__rx", F.lit(0)).alias("has_drug"))
    w = Window.partitionBy("has_drug").orderBy(hash_rank(seed, key), key)
    return e.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= max(n_empty, n_filled)) & (F.col("__r") <= F.when(F.col("has_drug") == 0, n_empty).otherwise(n_filled))).drop("__r")


def strata_draw(df: DataFrame, strata: list[tuple[str, Column]], key: str, n: int, seed: int, rest: str = "rest") -> DataFrame:
    """n rows of each stratum; a row belongs to the first stratum whose test it meets."""
    name = F.lit(rest)
    for k, test in reversed(strata):
        name = F.when(test, k).otherwise(name)
    return stratified_sample(df.withColumn("stratum", name), "stratum", key, {}, n, seed)


def holdout_keys(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.select(key).distinct().orderBy(hash_rank(seed, key), key).limit(n)


def exemplars(train: DataFrame, rx: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k train rows, those without drugs at the corpus rate but never all."""
    e = train.select(key).join(rx.select(key).distinct().withColumn("__rx", F.lit(1)), key, "left").select(key, F.coalesce("__rx", F.lit(0)).alias("has_drug"))
    quota = e.agg(F.least(F.round(k * F.avg(1 - F.col("has_drug"))).cast("int"), F.lit(k - 1)).alias("__q"))
    w = Window.partitionBy("has_drug").orderBy(hash_rank(seed, key), key)
    ranked = e.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return ranked.join(F.broadcast(quota)).where(F.col("__r") <= F.when(F.col("has_drug") == 0, F.col("__q")).otherwise(k - F.col("__q"))).drop("__r", "__q")
