"""Vocabularies, frequencies, strata and per-column statistics, all fitted on train rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import if_small, spread, stored

SPECIALS = ("<pad>", "<bos>", "<eos>", "<unk>")


def per_value(df: DataFrame, col: str, f: dict[str, Column] | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with columns that depend on one column only and cost much a row: computed once for each distinct value
    and joined back, nulls too. The values are written once; few are broadcast, many meet their rows in a shuffle.

    f is the columns, or a function of the table of distinct values that keeps `col`."""
    values = df.select(col).distinct()
    values = stored(values.withColumns(f) if isinstance(f, dict) else f(values)).withColumnRenamed(col, "__value")
    few = if_small(values, 5_000)
    values = values if few is None else few
    return df.join(values, df[col].eqNullSafe(values["__value"]), "left").drop("__value")


def token_freq(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def char_freq(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(F.split(F.array_join(tokens, ""), "")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("freq"))


def build_vocab(freq: DataFrame, min_freq: int = 1, specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """(token, id, freq) by falling frequency, then token, after the reserved ids.

    Ids are counts of earlier (frequency, first two letters) cells plus ranks inside the cell, so no
    task orders the whole vocabulary."""
    f = freq.where((F.col("freq") >= min_freq) & ~F.col("token").isin(*specials)).withColumn("head", F.substring("token", 1, 2))
    cells = f.groupBy("freq", "head").agg(F.count("*").alias("n"))
    before = cells.select("freq", "head", (F.sum("n").over(Window.orderBy(F.desc("freq"), "head")) - F.col("n")).alias("before"))  # over cells
    inside = F.row_number().over(Window.partitionBy("freq", "head").orderBy("token"))
    ids = f.join(before, ["freq", "head"]).select("token", (F.col("before") + inside - 1 + len(specials)).cast("long").alias("id"), "freq")
    head = freq.sparkSession.createDataFrame([(s, k, 0) for k, s in enumerate(specials)], "token string, id long, freq long")
    return ids.unionByName(head)


def encode_ids(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, unknown: int = 3) -> DataFrame:
    """(key, ids): each token's id in order, unknown ones as the unknown id."""
    pos = df.select(key, F.posexplode(tokens).alias("pos", "token"))
    ids = pos.join(vocab.select("token", "id"), "token", "left").select(key, "pos", F.coalesce("id", F.lit(unknown)).alias("id"))
    return ids.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def drug_freq(labels: DataFrame, train: DataFrame, key: str, item: str) -> DataFrame:
    """All labels with their train frequency, 0 included."""
    n = labels.join(train.select(key), key, "left_semi").groupBy(item).agg(F.count("*").alias("freq"))
    return labels.select(item).distinct().join(n, item, "left").select(item, F.coalesce("freq", F.lit(0)).alias("freq"))


def stratum(freq) -> Column:
    return F.when(freq >= 100, "head").when(freq >= 10, "mid").when(freq >= 1, "tail").otherwise("unseen")


def norm_stats(df: DataFrame, cols: list[str], train: Column | None = None) -> DataFrame:
    """(column, mean, std, missing): sample deviation, 0 taken as 1, over train rows."""
    d = df.where(F.col("split") == "train" if train is None else train)
    rows = d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols))).alias("x")).select("x.*")
    sd = F.stddev_samp("v")
    return rows.groupBy("column").agg(F.avg("v").alias("mean"), F.when((sd == 0) | sd.isNull(), 1.0).otherwise(sd).alias("std"), F.avg(F.col("v").isNull().cast("double")).alias("missing"))


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key; the smallest one wins a tie."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def fold_rare(df: DataFrame, col: str, n: int, train: Column, other: str = "OTHER") -> DataFrame:
    """Values outside the n most frequent on train become `other`."""
    top = df.where(train & F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), col).limit(n)
    return df.join(F.broadcast(top.select(col).withColumn("__top", F.lit(1))), col, "left").withColumn(col, F.when(F.col("__top") == 1, F.col(col)).otherwise(other)).drop("__top")


def top_classes(rx: DataFrame, train: DataFrame, key: str, label: str, n: int) -> DataFrame:
    return rx.join(train.select(key), key, "left_semi").groupBy(label).agg(F.countDistinct(key).alias("support")).orderBy(F.desc("support"), label).limit(n)


def count_targets(enc: DataFrame, kinds: dict[str, DataFrame], key: str) -> DataFrame:
    out = enc.select(key)
    for name, df in kinds.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.fillna(0, list(kinds))


def multi_hot(enc: DataFrame, link: DataFrame, key: str, label: str, values: list[str]) -> DataFrame:
    """0/1 columns for a given list of labels: a bit a label, and links and rows meet in one shuffle by key."""
    bits = [F.coalesce(F.when(F.col(label) == v, F.lit(1 << (k % 60))), F.lit(0)).cast("long") for k, v in enumerate(values)]
    masks = [sum(bits[a : a + 60], F.lit(0).cast("long")).alias(f"__m{a // 60}") for a in range(0, len(bits), 60)]
    of = [f"__m{k}" for k in range(len(masks))]
    links = link.where(F.col(key).isNotNull()).select(key, *masks, F.lit(0).alias("__r"))
    rows = enc.select(key, *(F.lit(0).cast("long").alias(m) for m in of), F.lit(1).alias("__r"))
    sums = spread(rows.unionByName(links), key).groupBy(key).agg(*(F.bit_or(m).alias(m) for m in of), F.sum("__r").alias("__r")).where("__r > 0")
    one = sums.select(key, *of, F.explode(F.array_repeat(F.lit(0), F.col("__r").cast("int"))).alias("__r"))
    return one.select(key, *(F.shiftright(F.col(f"__m{k // 60}"), k % 60).bitwiseAND(F.lit(1)).cast("int").alias(v) for k, v in enumerate(values)))


def canonical_order(rx: DataFrame, freq: DataFrame, key: str, item: str) -> DataFrame:
    """Rank of each item in its key: most frequent on train first, then the id."""
    w = Window.partitionBy(key).orderBy(F.desc("freq"), item)
    return rx.select(key, item).distinct().join(freq, item, "left").select(key, item, F.row_number().over(w).alias("pos"))
