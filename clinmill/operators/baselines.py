"""Label spaces, floors and priors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import prf
from .select import quantiles


def supported_labels(link: DataFrame, train: DataFrame, key: str, label: str, least: int) -> DataFrame:
    """(label, support, idx): labels with enough distinct train encounters, most supported first."""
    n = link.join(train.select(key), key, "left_semi").groupBy(label).agg(F.countDistinct(key).alias("support")).where(F.col("support") >= least)
    return n.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("support"), label)) - 1)  # over labels


def form_labels(rx: DataFrame, key: str, form: str, keep: list[str]) -> DataFrame:
    from .vocab import mode_per_key

    m = mode_per_key(rx, key, form)
    return m.select(key, F.when(F.col(form).isin(*keep), F.col(form)).otherwise("other").alias(form))


def modal_set(gold: DataFrame) -> DataFrame:
    """The most frequent label set; the smallest one wins a tie."""
    s = gold.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")).groupBy("labels").agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), "labels").limit(1)


def global_prior(gold: DataFrame, k: int) -> DataFrame:
    return gold.select("row_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(k)


def prior_topk(train: DataFrame, val: DataFrame, kmax: int) -> DataFrame:
    """(k, micro_f1) of always giving the k most frequent train labels, on val rows with gold labels."""
    top = global_prior(train, kmax)
    r = top.select("label", F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("r"))
    g = val.select("row_id", "label").distinct()
    rows = g.agg(F.countDistinct("row_id").alias("rows"), F.count("*").alias("n_gold"))
    tp = r.join(g.groupBy("label").agg(F.count("*").alias("hits")), "label", "left").fillna(0, ["hits"])
    cum = tp.select(F.col("r").alias("k"), F.sum("hits").over(Window.orderBy("r")).alias("tp")).join(F.broadcast(rows))
    return cum.select("k", prf("tp", F.col("k") * F.col("rows"), "n_gold")["f1"].alias("micro_f1"))


def group_prior(rows: DataFrame, group: str, label: str, k: int, keys: DataFrame) -> DataFrame:
    """(group, label, rank): k most frequent labels of each group of keys; the global ones where it has none."""
    w = Window.partitionBy(group).orderBy(F.desc("n"), label)
    own = rows.groupBy(group, label).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, label, "rank")
    top = rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)
    top = top.select(label, F.row_number().over(Window.orderBy(F.desc("n"), label)).alias("rank"))
    none = keys.select(group).distinct().join(own.select(group), group, "left_anti")
    return own.join(keys.select(group).distinct(), group, "left_semi").unionByName(none.join(F.broadcast(top)))


def scalar_floors(train: DataFrame, y: str, label: str) -> DataFrame:
    n = train.groupBy(label).agg(F.count("*").alias("n")).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"))
    median = quantiles(train, {y: [0.5]})[y][0]
    return train.agg(F.avg(y).alias("mean")).select(F.lit(median).cast("double").alias("median"), "mean").join(F.broadcast(n))
