"""Calibration and operating points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import logit, prf

LEAST_POSITIVES = 10
GRID = [round(0.05 + 0.01 * k, 2) for k in range(66)]


def threshold_curve(df: DataFrame, by: list[str] = (), grid: list[float] = GRID) -> DataFrame:
    """(by, thr, tp, n_pred, n_gold): counts at each grid threshold from one histogram of (p, y)."""
    by = list(by)
    b = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in grid[1:]), F.when(F.col("p") >= grid[0], 1).otherwise(0))
    c = df.groupBy(*by, b.alias("b")).agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    for k in by:
        c = c.where(F.col(k).isNotNull())
    t = c.groupBy(*by).agg(F.sum("pos").alias("n_gold"), F.collect_list(F.struct("b", "n", "pos")).alias("h")).where(F.size("h") > 0)  # of len(grid) + 1 entries at most
    t = t.select(*by, "n_gold", "h", F.posexplode(F.array(*(F.lit(x) for x in grid))).alias("i", "thr"))
    above = lambda x, kind: F.aggregate(F.filter("h", lambda e: e["b"] > F.col("i")), F.lit(0).cast(kind), lambda s, e: s + F.coalesce(e[x], F.lit(0).cast(kind)))
    return t.select(*by, "thr", "n_gold", above("pos", c.schema["pos"].dataType).alias("tp"), above("n", "long").alias("n_pred"))


def tune_threshold(df: DataFrame, by: list[str] = (), grid: list[float] = GRID) -> DataFrame:
    """(by, thr, micro_f1): the first grid threshold of the best micro F1."""
    c = threshold_curve(df, by, grid).withColumn("micro_f1", F.round(prf("tp", "n_pred", "n_gold")["f1"], 9))
    return c.groupBy(*by).agg(F.min_by(F.struct("thr", "micro_f1"), F.struct(-F.col("micro_f1"), "thr")).alias("s")).select(*by, "s.*")


def size_matched_threshold(df: DataFrame, size: float, n_rows: int, grid: list[float] = GRID) -> DataFrame:
    """The grid threshold whose mean predicted size is nearest to `size`."""
    c = threshold_curve(df, [], grid).withColumn("gap", F.round(F.abs(F.col("n_pred") / n_rows - size), 9))
    return c.groupBy().agg(F.min_by("thr", F.struct("gap", "thr")).alias("thr"))


def threshold_by_group(df: DataFrame, group: str, least: int = 30) -> DataFrame:
    """Thresholds of groups with enough rows; the others take the overall one."""
    n = df.groupBy(group).agg(F.countDistinct("row_id").alias("__n"))
    own = tune_threshold(df, [group]).select(group, F.col("thr").alias("__own"))
    return n.join(own, group).join(F.broadcast(tune_threshold(df).select(F.col("thr").alias("__all")))).select(group, F.when(F.col("__n") >= least, F.col("__own")).otherwise(F.col("__all")).alias("thr"))


def span_max(pred: DataFrame) -> DataFrame:
    """Score of a row's label: the largest over its spans."""
    return pred.groupBy("row_id", "label").agg(F.max("p").alias("p"))


def isotonic(df: DataFrame):
    """The isotonic fit of (p, y) by pyspark.ml."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol="f", labelCol="label").fit(df.select(array_to_vector(F.array("p")).alias("f"), F.col("y").cast("double").alias("label")))


def apply_isotonic(df: DataFrame, model) -> DataFrame:
    """df with p_cal: the model's own search among its knots, linear between them, the end values outside."""
    from pyspark.ml.functions import array_to_vector

    out = model.setFeaturesCol("__f").setPredictionCol("__y").transform(df.withColumn("__f", array_to_vector(F.array(F.col("p").cast("double")))))
    return out.withColumn("p_cal", F.greatest(F.least("__y", F.lit(1.0)), F.lit(0.0))).drop("__f", "__y")


def platt(df: DataFrame) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on the logit of p."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    m = LogisticRegression(featuresCol="f", labelCol="label", standardization=False, maxIter=100).fit(df.select(array_to_vector(F.array(logit("p"))).alias("f"), F.col("y").cast("double").alias("label")))
    return float(m.coefficients[0]), float(m.intercept)


def calibrate(fit: DataFrame, apply: DataFrame, method: str) -> DataFrame:
    """apply with p_cal; fewer than LEAST_POSITIVES positives, or no negatives, leave p as it is."""
    c = fit.agg(F.sum("y").alias("s"), F.count("*").alias("n")).first()
    if method == "none" or (c["s"] or 0) < LEAST_POSITIVES or c["s"] == c["n"]:
        return apply.withColumn("p_cal", F.col("p"))
    if method == "isotonic":
        return apply_isotonic(apply, isotonic(fit))
    a, b = platt(fit)
    return apply.withColumn("p_cal", 1 / (1 + F.exp(-(a * logit("p") + b))))


def select_calibrator(df: DataFrame, fold, n_folds: int = 5, methods=("none", "sigmoid", "isotonic")) -> DataFrame:
    """(method, ece): mean out-of-fold calibration error inside validation; the smallest wins."""
    from .metrics import ece

    d = df.withColumn("__fold", fold % n_folds)
    out = None
    for m in methods:
        for k in range(n_folds):
            test = calibrate(d.where(F.col("__fold") != k), d.where(F.col("__fold") == k), m)
            e = ece(test.select(F.col("p_cal").alias("p"), "y"), []).withColumn("method", F.lit(m))
            out = e if out is None else out.unionByName(e)
    return out.groupBy("method").agg(F.avg("ece").alias("ece"))
