"""Scoring predicted sets and probabilities; all from long tables, so every metric is joins and sums."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import prf
from ..sources.scratch import spread


def pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(row_id, label, g, h): distinct pairs of either side with their flags."""
    g = gold.select("row_id", "label").distinct().withColumn("g", F.lit(1))
    h = pred.select("row_id", "label").distinct().withColumn("h", F.lit(1))
    return g.join(h, ["row_id", "label"], "full_outer").fillna(0, ["g", "h"])


def row_counts(gold: DataFrame, pred: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row_id, tp, n_pred, n_gold); rows adds rows without any label, and only its rows stay.

    Both sides and the rows meet in one shuffle by row_id and are added up there, without a join. Pairs with a null
    equal nothing."""
    side = lambda d, s: d.select("row_id", "label", F.lit(s).alias("s"))
    u = side(gold, 1).unionByName(side(pred, 2))
    if rows is not None:
        u = u.unionByName(side(rows.select("row_id", F.lit(None).cast(gold.schema["label"].dataType).alias("label")), 3))
    # what follows from the side is added after the shuffle
    apart = F.when(F.col("row_id").isNull() | F.col("label").isNull(), F.col("s")).alias("__s")
    u = spread(u, "row_id").select("row_id", "label", apart, *((F.col("s") == k).cast("int").alias(x) for k, x in enumerate("ghr", 1)))
    each = u.groupBy("row_id", "label", "__s").agg(F.max("g").alias("g"), F.max("h").alias("h"), F.sum("r").alias("r"))
    c = each.groupBy("row_id").agg(F.sum(F.col("g") * F.col("h")).alias("tp"), F.sum("h").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum("r").alias("r"))
    if rows is None:
        return c.drop("r")
    none = F.col("row_id").isNull()
    sums = [F.when(none, F.lit(0)).otherwise(F.col(x)).alias(x) for x in ("tp", "n_pred", "n_gold")]
    return c.where("r > 0").select("row_id", *sums, F.explode(F.array_repeat(F.lit(0), F.col("r").cast("int"))).alias("r")).drop("r")


def set_metrics(rows: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1, mean Jaccard (two empty sets agree), exact match, sizes, empty rate."""
    c = row_counts(gold, pred, rows)
    union = F.col("n_pred") + F.col("n_gold") - F.col("tp")
    agg = c.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"), F.avg(F.when(union == 0, 1.0).otherwise(F.try_divide("tp", union))).alias("jaccard"), F.avg((union == F.col("tp")).cast("double")).alias("exact_match"), F.avg("n_pred").alias("mean_pred_size"), F.avg("n_gold").alias("mean_gold_size"), F.avg((F.col("n_pred") == 0).cast("double")).alias("empty_pred_rate"))
    m = prf("tp", "n_pred", "n_gold")
    return agg.select(m["precision"].alias("micro_precision"), m["recall"].alias("micro_recall"), m["f1"].alias("micro_f1"), "jaccard", "exact_match", "mean_pred_size", "mean_gold_size", "empty_pred_rate")


def label_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return pairs(gold, pred).groupBy("label").agg(F.sum(F.col("g") * F.col("h")).alias("tp"), F.sum("h").alias("n_pred"), F.sum("g").alias("n_gold"))


def macro_f1(gold: DataFrame, pred: DataFrame, labels: DataFrame, tail: DataFrame) -> DataFrame:
    """Macro F1 over labels with gold rows, over all labels, over labels seen on either side, and over tail labels."""
    c = labels.select("label").distinct().join(label_counts(gold, pred), "label", "left").fillna(0, ["tp", "n_pred", "n_gold"]).join(tail.select("label").distinct().withColumn("__t", F.lit(1)), "label", "left")
    c = c.withColumn("f1", prf("tp", "n_pred", "n_gold")["f1"])
    mean = lambda test: F.coalesce(F.avg(F.when(test, F.col("f1"))), F.lit(0.0))
    return c.agg(mean(F.col("n_gold") > 0).alias("macro_present"), mean(F.lit(True)).alias("macro_all"), mean(F.col("n_gold") + F.col("n_pred") > 0).alias("macro_seen"), mean(F.col("__t") == 1).alias("macro_tail"))


def tail_labels(gold: DataFrame) -> DataFrame:
    """The half of the labels with the fewest rows."""
    n = gold.select("row_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    r = n.select("label", F.row_number().over(Window.orderBy("n", "label")).alias("r"), F.count("*").over(Window.partitionBy()).alias("k"))  # over labels
    return r.where(F.col("r") <= F.greatest(F.floor(F.col("k") / 2), F.lit(1))).select("label")


def by_stratum(gold: DataFrame, pred: DataFrame, strata: DataFrame) -> DataFrame:
    c = label_counts(gold, pred).join(strata, "label")
    s = c.groupBy("stratum").agg(F.count("*").alias("n_labels"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"), F.avg(prf("tp", "n_pred", "n_gold")["f1"]).alias("macro_f1"))
    return s.select("stratum", "n_labels", prf("tp", "n_pred", "n_gold")["f1"].alias("micro_f1"), "macro_f1")


def at_k(gold: DataFrame, pred: DataFrame, ks: list[int]) -> DataFrame:
    """(k, precision, recall): precision over all scored rows, recall over rows with gold labels."""
    w = Window.partitionBy("row_id").orderBy(F.desc("p"), "label")
    best = pred.groupBy("row_id", "label").agg(F.max("p").alias("p")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= max(ks))
    g = gold.select("row_id", "label").distinct()
    hits = best.join(g.withColumn("__g", F.lit(1)), ["row_id", "label"], "left").groupBy("row_id").agg(*(F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("__g"))), F.lit(0)).alias(f"h{k}") for k in ks))
    j = hits.join(g.groupBy("row_id").agg(F.count("*").alias("n")), "row_id", "left")
    one = j.agg(*(F.avg(F.col(f"h{k}") / k).alias(f"p{k}") for k in ks), *(F.avg(F.when(F.col("n") > 0, F.col(f"h{k}") / F.col("n"))).alias(f"r{k}") for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("precision"), F.col(f"r{k}").alias("recall")) for k in ks))).alias("x")).select("x.*")


def empty_rx(counts: DataFrame) -> DataFrame:
    """How well empty sets are found, from row_counts."""
    e, g = F.col("n_pred") == 0, F.col("n_gold") == 0
    c = counts.agg(F.count_if(e & g).alias("tp"), F.count_if(e).alias("n_pred"), F.count_if(g).alias("n_gold"), F.count("*").alias("n"))
    return c.select(*(v.alias(k) for k, v in prf("tp", "n_pred", "n_gold").items()), (F.col("n_pred") / F.col("n")).alias("pred_rate"), (F.col("n_gold") / F.col("n")).alias("gold_rate"))


def ece(df: DataFrame, by: list[str], bins: int = 10, side: str = "left") -> DataFrame:
    """Expected calibration error of (p, y). left: bins [a, b), 1 in the last; right: bins (a, b], 0 left out."""
    if side == "left":
        b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    else:
        b = F.when(F.col("p") > 0, F.ceil(F.col("p") * bins))
    c = df.groupBy(*by, b.alias("b")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    tot = c.groupBy(*by).agg(F.sum(F.when(F.col("b").isNotNull(), F.abs(F.col("sy") - F.col("sp"))).otherwise(0.0)).alias("gap"), F.sum("n").alias("n"))
    return tot.select(*by, (F.col("gap") / F.col("n")).alias("ece"))


def brier(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"))


def _before(c: DataFrame, by: list[str], cols: list[str], desc: bool, parts: int = 1024) -> DataFrame:
    """c (distinct scores p in 0..1) with before_<col>: sums over the scores that come first. Totals by
    score range run first, so the inner windows each hold one range."""
    c = c.withColumn("__b", F.floor(F.col("p") * parts))
    o = (lambda x: F.desc(x)) if desc else (lambda x: F.asc(x))
    prior = Window.unboundedPreceding
    t = c.groupBy(*by, "__b").agg(*(F.sum(x).alias(x) for x in cols))
    w = Window.partitionBy(*by).orderBy(o("__b")).rowsBetween(prior, -1)
    t = t.select(*by, "__b", *(F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias(f"__t_{x}") for x in cols))
    inner = Window.partitionBy(*by, "__b").orderBy(o("p")).rowsBetween(prior, -1)
    return c.join(t, [*by, "__b"]).withColumns({f"before_{x}": F.col(f"__t_{x}") + F.coalesce(F.sum(x).over(inner), F.lit(0.0)) for x in cols})


def auroc(df: DataFrame, by: list[str]) -> DataFrame:
    """Exact area by rank sums with average ranks on ties; windows run over distinct scores."""
    c = df.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    c = _before(c, by, ["neg"], desc=False)
    s = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return s.select(*by, F.try_divide("u", F.col("np") * F.col("nn")).alias("auroc"))


def avg_precision(df: DataFrame, by: list[str]) -> DataFrame:
    c = df.groupBy(*by, "p").agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    c = _before(c, by, ["pos", "n"], desc=True)
    c = c.withColumns({"tp": F.col("before_pos") + F.col("pos"), "k": F.col("before_n") + F.col("n")})
    s = c.groupBy(*by).agg(F.sum(F.col("tp") / F.col("k") * F.col("pos")).alias("a"), F.sum("pos").alias("np"))
    return s.select(*by, F.try_divide("a", "np").alias("avg_precision"))


def count_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    d = F.col(p) - F.col(y)
    ss = F.sum(F.pow(F.col(y), F.lit(2.0))) - F.count(y) * F.pow(F.avg(y), F.lit(2.0))
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), (1 - F.try_divide(F.sum(d * d), ss)).alias("r2"))


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and the majority baseline, from confusion counts."""
    c = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    g = c.groupBy(F.col("y").alias("k")).agg(F.sum("n").alias("n_gold"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    h = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("n_pred"))
    j = g.join(h, "k", "full_outer").fillna(0)
    f = prf("tp", "n_pred", "n_gold")
    return j.agg((F.sum("tp") / F.sum("n_gold")).alias("accuracy"), F.avg(F.when(F.col("n_gold") > 0, f["recall"])).alias("balanced_accuracy"), F.avg(f["f1"]).alias("macro_f1"), (F.max("n_gold") / F.sum("n_gold")).alias("majority"))


def attribute_accuracy(gold: DataFrame, pred: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """Accuracy of each attribute on the pairs that were predicted rightly."""
    j = gold.select(*key, *(F.col(a).alias(f"g_{a}") for a in attrs)).join(pred.select(*key, *attrs), key)
    one = j.agg(F.count("*").alias("n"), *(F.avg((F.col(a) == F.col(f"g_{a}")).cast("double")).alias(a) for a in attrs))
    return one.unpivot(["n"], attrs, "attribute", "accuracy")


#: Rows of a kind up to which its weight is drawn by inversion.
EXACT = 256


#: Rows of a kind up to which its weight is drawn by inversion.
EXACT = 256


@lru_cache(maxsize=EXACT)
def _poisson_cdf(m: int) -> np.ndarray:
    """P(count <= k) of a Poisson count of mean m, for k up to far in the tail."""
    k = np.arange(int(m + 12 * math.sqrt(m) + 30) + 1)
    return np.cumsum(np.exp(k * math.log(m) - m - np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))))


def kind_weights(kind: str, m: int, n_boot: int, seed: int) -> np.ndarray:
    """For each replicate the sum of the Poisson(1) weights of the m rows of a kind, a whole number.

    That sum is Poisson(m): it is drawn by inverting the distribution at a hash of (seed, replicate, kind). Above EXACT
    rows it is a normal number of the same mean, variance and skewness, rounded, which is within a hundredth of a
    standard deviation. A digest serves four replicates."""
    digests = b"".join(hashlib.md5(f"{seed}:{d}:{kind}".encode()).digest() for d in range(-(-n_boot // 4)))
    u = (np.frombuffer(digests, ">u4").astype(float) + 0.5) / 2**32
    if m <= EXACT:
        return np.searchsorted(_poisson_cdf(m), u[:n_boot], "right").astype(float)
    length, turn = np.sqrt(-2 * np.log(u[0::2])), 2 * math.pi * u[1::2]
    z = np.stack([length * np.cos(turn), length * np.sin(turn)], 1).ravel()[:n_boot]
    return np.maximum(np.rint(m + math.sqrt(m) * z + (z * z - 1) / 6), 0.0)


def bootstrap(counts: DataFrame, by: list[str], n_boot: int = 1000, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(by, b, micro_f1): paired replicates from row counts, every system on the same resamples.

    Rows whose counts agree in all systems can be exchanged, so each kind of row is drawn as a whole, with the sum of
    its rows' Poisson(1) weights (kind_weights). The work is the number of kinds times replicates, whatever the
    number of rows; a task sends its sums by system and replicate. A `weight` column, the same in all systems, says how
    many rows a row stands for."""
    sums = ["tp", "n_pred", "n_gold"]
    row = counts.groupBy("row_id").agg(F.first(weight).alias("m") if weight else F.lit(1).alias("m"), F.sort_array(F.collect_list(F.struct(*by, *sums))).alias("c"))  # an entry per system
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", *(x[k].cast("string") for k in [*by, *sums]))), ";")
    kind = row.groupBy(text.alias("k")).agg(F.sum("m").alias("m"), F.first("c").alias("c"))
    kind = kind.select("k", "m", *(F.col(f"c.{n}").alias(n) for n in by), *(F.col(f"c.{n}").cast("array<double>").alias(n) for n in sums)).repartition("k")

    def replicates(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for x in pdf.to_dict("records"):
                w = kind_weights(x["k"], x["m"], n_boot, seed)
                for i in range(len(x["tp"])):
                    key = tuple(x[c][i] for c in by)
                    part = np.outer(w, [x[c][i] for c in sums])
                    total[key] = total[key] + part if key in total else part
        for key, t in total.items():
            yield pd.DataFrame({**dict(zip(by, key, strict=True)), "b": np.arange(n_boot, dtype=np.int32), **{c: t[:, i] for i, c in enumerate(sums)}})

    kinds = ", ".join([*(f"{c} {counts.schema[c].dataType.simpleString()}" for c in by), "b int", *(f"{c} double" for c in sums)])
    s = kind.mapInPandas(replicates, kinds).groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in sums))
    return s.select(*by, "b", prf(*sums)["f1"].alias("micro_f1"))


def delta_stats(arm: DataFrame, ref: DataFrame, value: str, relative: bool = False) -> DataFrame:
    """Mean, 95 % interval and share above 0 of the difference of replicates; relative adds the mean share of ref."""
    j = arm.select("b", F.col(value).alias("x")).join(ref.select("b", F.col(value).alias("y")), "b").select((F.col("x") - F.col("y")).alias("d"), F.try_divide(F.col("x") - F.col("y"), F.col("y")).alias("r"))
    more = [F.avg("r").alias("relative")] if relative else []
    return j.agg(F.avg("d").alias("delta"), F.percentile("d", F.lit(0.025)).alias("lo95"), F.percentile("d", F.lit(0.975)).alias("hi95"), F.avg((F.col("d") > 0).cast("double")).alias("p_better"), *more)
