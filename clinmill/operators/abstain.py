"""Selective prediction: confidence, risk against coverage, frozen cut-points and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import prf
from ..sources.scratch import placed, spread, stored
from .select import quantiles

GRID = [round(0.05 * k, 2) for k in range(1, 21)]
MARGIN = 1e-4


#: Rows of a cell of a curve, which are ranked in one place.
CELL = 1 << 16


def confidence(pred: DataFrame, thr: float, of: DataFrame | None = None) -> DataFrame:
    """Per row of (row_id, label, p): max_prob, margin, n_above_thr, neg_entropy, expected_f1 at a threshold.

    A row's labels meet in partitions of a fixed size before they are added up (spread; `of` as there). expected_f1 adds them up in
    the order of the table, so that rows that tie to the last bit in SQL tie here and a cut between them falls alike, however they are dealt out."""
    p, eps = F.col("p"), 1e-9
    hit = p >= thr
    added = lambda of: F.aggregate("__l", F.lit(0.0), lambda s, x: s + of(x["p"]))
    top = spread(placed(pred.select("row_id", "p"), "__i"), "row_id", of=of).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.when(p.isNotNull(), F.struct("__i", "p")))).alias("__l"),
        F.count_if(hit).cast("double").alias("n_above_thr"),
        F.sum(p * F.log(p + eps) + (1 - p) * F.log(1 - p + eps)).alias("neg_entropy"),
    )
    two = F.slice(F.sort_array(F.transform("__l", lambda x: x["p"]), asc=False), 1, 2)
    f1 = 2 * added(lambda v: F.when(v >= thr, v).otherwise(0.0)) / F.greatest(F.col("n_above_thr") + added(lambda v: v), F.lit(1e-9))
    top = top.select("row_id", two.alias("__t"), "n_above_thr", "neg_entropy", f1.alias("expected_f1"))
    return top.select("row_id", F.get("__t", F.lit(0)).alias("max_prob"), (F.get("__t", F.lit(0)) - F.coalesce(F.get("__t", F.lit(1)), F.lit(0.0))).alias("margin"), "n_above_thr", "neg_entropy", "expected_f1")


def risk_coverage(counts: DataFrame, conf: str, grid: list[float] = GRID, cells: int = 64) -> DataFrame:
    """(coverage, n, micro_f1): quality of the most confident share of rows, by confidence to six
    decimals, ties by row_id.

    Rows are written once. Running totals over distinct confidences find the one that holds each cut, those over
    ranges of row_id of its rows the range, and only the rows of that range are ranked; no task sorts all rows."""
    return _curve(stored(counts.select("row_id", F.col(conf).alias("s"), *SUMS)), "s", grid, cells)


#: What a curve adds up, and the steps of an unrounded confidence whose totals are taken.
SUMS, STEPS = ["tp", "n_pred", "n_gold"], 1 << 20


def _curve(counts: DataFrame, conf: str, grid: list[float], cells: int = 64, rounded: bool = True) -> DataFrame:
    """risk_coverage of stored rows. If not rounded, rows go by their whole confidence, in steps of 1 / STEPS and in parts of a
    step; only for confidences that spread over 0 to 1, as a random control does."""
    span = counts.agg(F.min("row_id").alias("__lo"), F.max("row_id").alias("__hi"), F.count("*").alias("__n"), F.greatest(F.lit(cells), F.ceil(F.count("*") / CELL)).alias("__k"))
    s = F.col(conf)
    if rounded:
        v, x, cell = F.round(s, 6), F.lit(0.0), F.floor((F.col("row_id") - F.col("__lo")) * F.col("__k") / (F.col("__hi") - F.col("__lo") + 1))
    else:
        v, x, cell = F.floor(s * STEPS).cast("double"), s, -F.floor((s * STEPS - F.floor(s * STEPS)) * F.col("__k"))
    want = span.select(F.explode(F.array(*(F.lit(g) for g in grid))).alias("coverage"), "__n").select("coverage", F.greatest(F.rint(F.col("coverage") * F.col("__n")), F.lit(1)).cast("long").alias("k"))
    held = (F.col("b_n") < F.col("k")) & (F.col("k") <= F.col("b_n") + F.col("n"))
    per = counts.select(v.alias("v"), *SUMS).groupBy("v").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in SUMS))
    before = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)  # over distinct confidences
    per = per.select("v", "n", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in ["n", *SUMS]))
    at = per.join(F.broadcast(want), held).select("v", *(F.col(f"b_{c}").alias(f"v_{c}") for c in ["n", *SUMS])).distinct()  # a row per cut at most
    r = counts.join(F.broadcast(span.select("__lo", "__hi", "__k"))).select("row_id", v.alias("v"), x.alias("x"), cell.alias("cell"), *SUMS).join(F.broadcast(at), "v")
    c = r.groupBy("v", "cell", *(f"v_{c}" for c in ["n", *SUMS])).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in SUMS))
    before = Window.partitionBy("v").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over the cells of a confidence
    c = c.select("v", "cell", "n", *((F.col(f"v_{x}") + F.coalesce(F.sum(x).over(before), F.lit(0))).alias(f"b_{x}") for x in ["n", *SUMS]))
    cut = c.join(F.broadcast(want), held).drop("n")
    r = r.drop(*(f"v_{c}" for c in ["n", *SUMS])).join(F.broadcast(cut), ["v", "cell"]).withColumn("r", F.row_number().over(Window.partitionBy("coverage").orderBy(F.desc("x"), "row_id")))
    part = r.where(F.col("r") <= F.col("k") - F.col("b_n")).groupBy("coverage", "k", *(f"b_{c}" for c in SUMS)).agg(*(F.sum(c).alias(c) for c in SUMS))
    return part.select("coverage", F.col("k").alias("n"), prf(*(F.col(c) + F.col(f"b_{c}") for c in SUMS))["f1"].alias("micro_f1"))


def select_signal(counts: DataFrame, signals: list[str], control: Column, grid: list[float] = GRID) -> DataFrame:
    """Mean of the curve of each signal and of a random control (0 to 1, not rounded); the best first. Rows are written once
    for all curves."""
    rows = stored(counts.select("row_id", *SUMS, *signals, control.alias("random")))
    out = None
    for s in [*signals, "random"]:
        one = _curve(rows, s, grid, rounded=s != "random").agg(F.avg("micro_f1").alias("auc")).withColumn("signal", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out.select("signal", "auc")


def cutpoints(conf: DataFrame, col: str, grid: list[float] = GRID) -> DataFrame:
    """(coverage, cutpoint, achieved): linear quantiles of confidence, and the share at or above each."""
    q = conf.sparkSession.createDataFrame(list(zip(quantiles(conf, {col: [round(1 - g, 2) for g in grid]})[col], grid, strict=True)), "cutpoint double, coverage double")
    return conf.select(col).join(F.broadcast(q)).groupBy("coverage", "cutpoint").agg(F.avg((F.col(col) >= F.col("cutpoint")).cast("double")).alias("achieved"))


def usable(auc_signal: Column, auc_random: Column, cut: Column) -> dict[str, Column]:
    """Whether a cut-point family may be used, and why not."""
    poor, floor = auc_signal <= auc_random + MARGIN, cut <= 1e-9
    return {"usable": ~poor & ~floor, "reason": F.when(poor, "signal does not beat the random control").when(floor, "cut-point lies on the confidence floor").otherwise("")}


def decide(conf: DataFrame, policy: DataFrame, mode: str = "global") -> DataFrame:
    """cover or not for each (component, row): frozen cut-points only, so a row's decision needs no other row.

    policy is (component, cutpoint, usable). mode sparse covers every row that isn't sparse."""
    j = conf.join(F.broadcast(policy), "component", "left")
    ok = F.coalesce(F.col("usable"), F.lit(False))
    free = ~ok if mode == "global" else ~ok | ~F.col("sparse")
    return j.withColumn("cover", F.when(free, True).otherwise(F.col("confidence") >= F.col("cutpoint")))


def check_threshold(policy: DataFrame, served: DataFrame) -> DataFrame:
    """Policies fitted at another threshold than the served one are made unusable."""
    j = policy.join(served.select("component", F.col("threshold").alias("__t")), "component", "left")
    return j.withColumn("usable", F.col("usable") & F.coalesce(F.abs(F.col("threshold") - F.col("__t")) <= 1e-9, F.lit(False))).drop("__t")


def max_abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("row_id", "label", F.col("p").alias("x")).join(b.select("row_id", "label", F.col("p").alias("y")), ["row_id", "label"])
    return j.agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_abs_diff"))


def policy_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and quality on the covered rows by group; counts has cover."""
    s = counts.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("cover").cast("double")).alias("coverage"), *(F.sum(F.when(F.col("cover"), F.col(c)).otherwise(0)).alias(c) for c in ("tp", "n_pred", "n_gold")))
    return s.select(*by, "n", "coverage", prf("tp", "n_pred", "n_gold")["f1"].alias("micro_f1"))


def rank_equivalence(conf: DataFrame, col: str, coverage: float) -> DataFrame:
    """(n, n_covered, cutpoint, n_differ): rows at or above the frozen cut, and those on which the cut disagrees with
    the batch's own choice, its n_covered best rows. The k-th largest value of the k rows above the cut is their
    minimum, so the batch needs no sort; rows that tie with it are all above the cut. Confidences are written once for all steps."""
    conf = stored(conf.select(col))
    cut = quantiles(conf, {col: [round(1 - coverage, 12)]})[col][0]  # 1 - 0.8 is no 0.2, and the rank would lie beside a whole one
    j = conf.withColumn("__c", F.lit(cut).cast("double"))
    kth = j.where(F.col(col) >= F.col("__c")).agg(F.min(col).alias("__t"), F.count("*").alias("__k"))
    j = j.join(F.broadcast(kth))
    batch = F.col(col) >= F.col("__t")
    out = j.agg(F.count("*").alias("n"), F.count_if(F.col(col) >= F.col("__c")).alias("n_covered"), F.count_if((F.col(col) >= F.col("__c")) != batch).alias("d"), F.count_if(batch).alias("b"), F.first("__k").alias("k"))
    return out.select("n", "n_covered", F.lit(cut).cast("double").alias("cutpoint"), (F.col("d") + F.abs(F.col("b") - F.col("k"))).alias("n_differ"))


def ranked(pred: DataFrame, k: int) -> DataFrame:
    """Each row's k best labels as one string, best first."""
    w = Window.partitionBy("row_id").orderBy(F.desc("p"), "label")
    top = pred.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ",").alias("labels"))
