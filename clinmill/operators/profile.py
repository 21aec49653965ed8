"""Profiles of tables: volumes, shares, distributions, concentration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def table_volumes(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def linkage_counts(parent: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Per child kind: rows, distinct keys, keys that have a parent."""
    keys = parent.select(key).distinct()
    parts = [c.join(keys.withColumn("__p", F.lit(1)), key, "left").agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.countDistinct(F.when(F.col("__p") == 1, F.col(key))).alias("n_valid")).withColumn("kind", F.lit(k)) for k, c in children.items()]
    return reduce(DataFrame.unionByName, parts)


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Counts per key and their share; the window runs over the counts only."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def order_count_hist(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """How many parents have 0, 1, 2... children, with shares."""
    n = child.groupBy(key).agg(F.count("*").alias("n_orders"))
    return share_of_total(parent.select(key).join(n, key, "left").select(F.coalesce("n_orders", F.lit(0)).alias("n_orders")), "n_orders")


def set_sizes(kinds: dict[str, DataFrame], key: str, item: str) -> DataFrame:
    parts = [df.select(key, item).distinct().groupBy(key).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean"), F.max("n").alias("max")).withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def vocab_sizes(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*(F.countDistinct(c).alias(c) for c in cols))
    return one.unpivot([], cols, "column", "n_distinct")


def visit_bands(enc: DataFrame, uid: str) -> DataFrame:
    n = F.col("n")
    band = F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")
    return enc.groupBy(uid).agg(F.count("*").alias("n")).groupBy(band.alias("band")).agg(F.count("*").alias("patients"), F.sum("n").alias("visits"))


def text_availability(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*(F.count(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))).alias(c) for c in cols))
    return one.unpivot([], cols, "column", "n_text")


def prescriber_concentration(enc: DataFrame, key: str) -> DataFrame:
    n = enc.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_prescribers"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


def length_dist(df: DataFrame, col: str) -> DataFrame:
    """Exact quantiles from the histogram of lengths, so the state grows with distinct lengths."""
    n = F.length(col)
    return df.agg(F.min(n).alias("min"), F.avg(n).alias("mean"), *(F.percentile(n, F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.99)), F.max(n).alias("max"))


def value_freq(df: DataFrame, col: str, top: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(top)


def dose_alias_audit(df: DataFrame, ident: str, canon) -> DataFrame:
    """Per canonical string: distinct ids and rows."""
    return df.groupBy(canon.alias("canon")).agg(F.countDistinct(ident).alias("n_ids"), F.count("*").alias("n_rows"))


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(*((100.0 * F.count(c) / F.count("*")).alias(c) for c in cols))
    return one.unpivot([], cols, "column", "pct")


def fk_quality(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key: nulls, zeros and orphans."""
    parts = []
    for c, dim in dims.items():
        d = dim.select(F.col(dim.columns[0]).alias(c)).distinct().withColumn("__d", F.lit(1))
        parts.append(df.select(c).join(d, c, "left").agg(F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c) == 0).alias("n_zero"), F.count_if(F.col(c).isNotNull() & F.col("__d").isNull()).alias("n_orphan")).withColumn("column", F.lit(c)))
    return reduce(DataFrame.unionByName, parts)


def text_checks(df: DataFrame, col: str, by: str) -> DataFrame:
    hit = lambda p: F.count_if(F.col(col).rlike(p))
    return df.groupBy(by).agg(F.count("*").alias("n"), hit("[\\u0980-\\u09ff]").alias("bengali"), hit("[A-Za-z]").alias("latin"), hit("<[^>]+>").alias("html"), hit("&[a-z]+;").alias("entity"))


def prevalence(flags: DataFrame, cols: list[str]) -> DataFrame:
    long = flags.select(*(F.col(c).cast("double") for c in cols)).unpivot([], cols, "flag", "v")
    return long.groupBy("flag").agg(F.count("v").alias("measured"), F.sum("v").alias("cases"), F.avg("v").alias("rate"))


def demo_availability(enc: DataFrame) -> DataFrame:
    return enc.agg(F.count("*").alias("n"), F.count("age").alias("with_age"), F.count("sex").alias("with_sex"), F.count_if(F.col("age").isNotNull() & F.col("sex").isNotNull()).alias("with_both"))


def empty_rx_profile(enc: DataFrame, rx: DataFrame, link: DataFrame, key: str, text: str) -> DataFrame:
    """Encounters with and without drugs: how many have a linked row, how many have text."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(1))
    j = enc.join(flag(rx, "__rx"), key, "left").join(flag(link, "__l"), key, "left")
    return j.groupBy(F.coalesce(F.col("__rx"), F.lit(0)).alias("has_drug")).agg(F.count("*").alias("n"), F.count("__l").alias("with_link"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) != "").alias("with_text"))


def label_concentration(df: DataFrame, label: str, ks: list[int]) -> DataFrame:
    """Share of all rows that the k most frequent labels hold, for each k."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), label)  # over distinct labels
    ranked = n.select(F.row_number().over(order).alias("k"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return ranked.where(F.col("k").isin(*ks)).select("k", (F.col("run") / F.col("all")).alias("share"))


def co_prescribed_pairs(rx: DataFrame, key: str, item: str, top: int) -> DataFrame:
    """Most frequent unordered pairs within a key, from distinct (key, item)."""
    d = rx.select(key, item).distinct()
    a, b = d.withColumnRenamed(item, "a"), d.withColumnRenamed(item, "b")
    return a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def term_contrast(df: DataFrame, text: str, term: str, measure: str) -> DataFrame:
    has = F.lower(text).contains(term)
    return df.groupBy(has.alias("has_term")).agg(F.count(measure).alias("n"), F.avg(measure).alias("mean"))


def set_diversity(df: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct sets, and the share of rows that have the most frequent one."""
    s = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_sets"), (F.max("n") / F.sum("n")).alias("modal_share"))


def seed_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def examples(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)
