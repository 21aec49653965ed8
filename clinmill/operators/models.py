"""Component models: linear models of all labels in shared passes, counts, and boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import fit_poisson_trees
from .passes import Rows, matrix, opened, packed, summed, vectors

#: Named feature sets from blocks of columns, and whether each can be had at prescribing time.
FEATURE_SETS = {
    "text": (("text",), True),
    "physio": (("physio",), True),
    "clinical": (("clinical",), True),
    "all": (("physio", "clinical", "context"), False),
    "text+physio": (("text", "physio"), True),
    "text+clinical": (("text", "clinical"), True),
    "text+all": (("text", "physio", "clinical", "context"), False),
    "deployable": (("text", "physio", "clinical"), True),
}


def feature_set(name: str, blocks: dict[str, list[str]]) -> Pipeline:
    cols = [c for b in FEATURE_SETS[name][0] for c in blocks.get(b, [])]
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")])


def feature_set_table(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """(feature_set, n_features, deployable, n, total) of every named set: the size of its vectors, whether it can be
    had at prescribing time, and rows and sum of entries of the assembled vectors."""
    out, arrays = df, {}
    for name in FEATURE_SETS:
        m = feature_set(name, blocks).getStages()[0].setOutputCol(f"__{name}")
        out = m.transform(out)
        arrays[name] = vector_to_array(F.col(f"`__{name}`"))
    one = [F.struct(F.lit(n).alias("feature_set"), F.lit(FEATURE_SETS[n][1]).alias("deployable"), F.size(a).alias("size"), F.aggregate(a, F.lit(0.0), lambda s, x: s + x).alias("sum")) for n, a in arrays.items()]
    rows = out.select(F.explode(F.array(*one)).alias("x")).select("x.*")
    return rows.groupBy("feature_set", "deployable").agg(F.max("size").alias("n_features"), F.count("*").alias("n"), F.sum("sum").alias("total"))


@dataclass
class Ovr:
    """One L2 logistic model per label: coefficients (features + 1, labels), the last of each the intercept; `fitted`
    is false for labels without train positives, which score 0."""

    labels: list[str]
    coefficients: np.ndarray
    fitted: np.ndarray


#: Size of the second derivatives of all labels up to which Newton steps are taken.
NARROW = 2_000_000


def fit_ovr(train: DataFrame, gold: DataFrame, labels: list[str], c: float = 1.0, rounds: int = 200, weight: str | None = None) -> Ovr:
    """All labels' models at once on (row_id, features): mean log loss plus |w|^2 / (2 c n), intercepts free.

    Vectors and the numbers of a row's labels are written once, equal rows of a task as one that weighs as many (passes);
    a `weight` column says how many rows a row stands for. A pass over them sums the loss and its derivatives of all
    labels that haven't settled, so the number of jobs doesn't grow with the labels. Few features: Newton
    steps, halved where the loss rises; many, or sparse ones: L-BFGS with the labels side by side. The driver holds
    coefficients and, for few features, second derivatives; never rows."""
    index = train.sparkSession.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, k int")
    hit, of = gold.select("row_id", "label").join(F.broadcast(index), "label").groupBy("row_id"), vectors(train, "features", "row_id", *([weight] if weight else []))
    if len(labels) < 63:  # a row's labels as bits: whole numbers are added up without lists
        of = of.join(hit.agg(F.expr("bit_or(shiftleft(1L, k))").alias("m")), "row_id", "left")
        y = F.array_compact(F.array(*(F.when(F.col("m").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(float(k))) for k in range(len(labels)))).cast("array<double>"))
    else:
        of = of.join(hit.agg(F.sort_array(F.collect_set(F.col("k").cast("double"))).alias("y")), "row_id", "left")
        y = F.coalesce("y", F.array().cast("array<double>"))
    rows, d = packed(of.select("xn", "xi", "xv", y.alias("y"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("n")))
    size = len(labels)

    def head_of(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(size + 1)
        for x, row, y, n in opened(pdf, d):
            out[-1] += n.sum()
            out[:-1] += np.bincount(y.astype(np.int64), n[row], size)
        return out

    head = summed(rows, head_of, size + 1)
    n, fitted = head[-1], head[:-1] > 0
    model = Ovr(labels, np.zeros((d + 1, size)), fitted)
    if not fitted.any():
        return model
    reg = np.full((d + 1, 1), 1.0 / (c * n))
    reg[-1] = 0.0

    def value(w: np.ndarray, who: np.ndarray, second: bool):
        """Loss (labels), gradient (d + 1, labels) and second derivatives (labels, d + 1, d + 1) at w."""
        k, e = len(who), d + 1

        def step(pdf: pd.DataFrame) -> np.ndarray:
            out = np.zeros(k + e * k + second * k * e * e)
            for x, row, at, n in opened(pdf, d):
                y = np.zeros((x.n, size))
                y[row, at.astype(np.int64)] = 1.0
                z, y, n = x.dot(w), y[:, who], n[:, None]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                one = [(n * (np.logaddexp(0.0, z) - y * z)).sum(0), x.tdot(n * (p - y)).ravel()]
                if second:
                    a = x.dense()
                    one += [((a * q[:, None]).T @ a).ravel() for q in (n * p * (1 - p)).T]
                out += np.concatenate(one)
            return out

        s = summed(rows, step, k + e * k + second * k * e * e) / n
        loss, grad = s[:k] + (reg * w * w).sum(0) / 2, s[k : k + e * k].reshape(e, k) + reg * w
        return loss, grad, s[k + e * k :].reshape(k, e, e) + np.diag(reg[:, 0]) if second else None

    who = np.flatnonzero(fitted)
    solve = _newton if (d + 1) ** 2 * len(who) <= NARROW else _lbfgs
    model.coefficients[:, who] = solve(value, d + 1, who, rounds)
    return model


def _newton(value, e: int, who: np.ndarray, rounds: int) -> np.ndarray:
    w, out = np.zeros((e, len(who))), np.zeros((e, len(who)))
    live, step, before = np.arange(len(who)), np.zeros((e, len(who))), np.full(len(who), np.inf)
    for _ in range(rounds):
        loss, grad, second = value(w[:, live], who[live], True)
        worse = loss > before[live] + 1e-12 * np.abs(before[live])
        for j, k in enumerate(live):
            if worse[j]:
                step[:, k] /= 2
                w[:, k] -= step[:, k]
            else:
                before[k], out[:, k] = loss[j], w[:, k]
                step[:, k] = -np.linalg.lstsq(second[j] + 1e-12 * np.eye(e), grad[:, j], rcond=None)[0]
                w[:, k] += step[:, k]
        live = np.array([k for k in live if np.abs(step[:, k]).max() > 1e-8 * max(1.0, np.abs(w[:, k]).max())], int)
        if not len(live):
            break
    return np.where(np.isfinite(w), w, out)


def _lbfgs(value, e: int, who: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    w = np.zeros((e, len(who)))
    f, g, _ = value(w, who, False)
    kept: list[list] = [[] for _ in who]
    size = np.zeros(len(who))  # of the step being tried, as a share of the direction; 0: a new direction is due
    way = np.zeros_like(w)
    live = np.arange(len(who))
    for _ in range(rounds):
        live = np.array([k for k in live if np.abs(g[:, k]).max() > 1e-8], int)
        if not len(live):
            break
        for k in live:
            if size[k] == 0:
                way[:, k] = -_two_loops(g[:, k], kept[k])
                size[k] = 1.0 if kept[k] else min(1.0, 1.0 / max(np.abs(g[:, k]).sum(), 1e-300))
        trial = w[:, live] + size[live] * way[:, live]
        loss, grad, _ = value(trial, who[live], False)
        for j, k in enumerate(live):
            slope = float(g[:, k] @ way[:, k])
            if loss[j] <= f[k] + 1e-4 * size[k] * slope or size[k] < 1e-10:
                s, y = trial[:, j] - w[:, k], grad[:, j] - g[:, k]
                if float(s @ y) > 1e-14 * float(s @ s):
                    kept[k] = [*kept[k][1 - memory :], (s, y)]
                if size[k] < 1e-10:
                    grad[:, j] = 0.0  # no step lowers the loss in double precision
                w[:, k], f[k], g[:, k], size[k] = trial[:, j], loss[j], grad[:, j], 0.0
            else:
                size[k] /= 2
    return w


def _two_loops(g: np.ndarray, kept: list) -> np.ndarray:
    q, a = g.copy(), []
    for s, y in reversed(kept):
        a.append(float(s @ q) / float(s @ y))
        q -= a[-1] * y
    if kept:
        s, y = kept[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), x in zip(kept, reversed(a), strict=True):
        q += (x - float(y @ q) / float(s @ y)) * s
    return q


def score_ovr(model: Ovr, df: DataFrame) -> DataFrame:
    """(row_id, label, p) of every row and label; p is 0 for labels without a model."""
    d = len(model.coefficients) - 1
    own = df.schema["row_id"].dataType.simpleString()

    def score(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b)
                z = Rows(b.to_pandas(), d).dot(model.coefficients) if x is None or x.shape[1] != d else x @ model.coefficients[:-1] + model.coefficients[-1]
                p = np.where(model.fitted, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)
                at = pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.ListArray.from_arrays(at, pa.array(p.ravel()))], ["row_id", "p"])

    p = vectors(df, "features", "row_id").mapInArrow(score, f"row_id {own}, p array<double>")
    names = F.array(*(F.lit(x) for x in model.labels))
    return p.select("row_id", F.posexplode("p").alias("i", "p")).select("row_id", F.get(names, F.col("i")).alias("label"), "p")


def multiclass(pred: DataFrame) -> DataFrame:
    """One-vs-rest probabilities normalised per row, with the best class."""
    t = pred.groupBy("row_id").agg(F.sum("p").alias("t"), F.count("*").alias("k"), F.max_by("label", F.struct("p", "label")).alias("best"))
    return pred.join(t, "row_id").select("row_id", "label", F.when(F.col("t") > 0, F.col("p") / F.col("t")).otherwise(1 / F.col("k")).alias("p"), "best")


def count_model(train: DataFrame, target: str, kind: str = "ridge", strength: float = 1.0):
    """Ridge, least absolute deviations ("lad"), or Huber; predictions are clipped at 0 by predict_counts."""
    if kind == "lad":
        return fit_lad(train, target, strength)
    lr = LinearRegression(labelCol=target, regParam=strength, elasticNetParam=0.0) if kind == "ridge" else LinearRegression(labelCol=target, loss="huber", regParam=strength, maxIter=50)
    return lr.fit(train)


@dataclass
class Linear:
    """A fitted line; transform adds `prediction`."""

    coefficients: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        w = F.array(*(F.lit(float(x)) for x in self.coefficients)).cast("array<double>")
        dot = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return df.withColumn("prediction", dot + float(self.intercept))


def fit_lad(train: DataFrame, target: str, strength: float = 0.0, rounds: int = 80, close: float = 1e-7) -> Linear:
    """Least absolute deviations, mean |y - wx - b| + strength / 2 |w|^2, by reweighted least squares.

    A row weighs the inverse of its residual, which is held above a floor that falls each round to a millionth of
    the target's mean deviation; a pass sums the weighted normal equations and the deviations, and the driver solves
    them. Rows without a target are left out. Ends when the coefficients settle at the last floor, with the best seen."""
    of = vectors(train.where(F.col(target).isNotNull()), "features", F.array(F.col(target).cast("double")).alias("y"))
    rows, d = packed(of.withColumn("n", F.lit(1.0)))

    def head_of(pdf: pd.DataFrame) -> np.ndarray:
        return sum((np.array([n.sum(), n @ y]) for _, _, y, n in opened(pdf, d)), np.zeros(2))

    n, total = summed(rows, head_of, 2)
    if not n:
        return Linear(np.zeros(d), 0.0)
    e, reg = d + 1, np.diag(np.append(np.full(d, strength), 0.0))
    w, best, least = np.zeros(e), np.zeros(e), np.inf
    w[-1] = total / n
    scale = floor = None
    for _ in range(rounds):

        def step(pdf: pd.DataFrame, w=w, floor=floor) -> np.ndarray:
            out = np.zeros(e * e + e + 1)
            for x, _, y, n in opened(pdf, d):
                a = x.dense()
                r = np.abs(y - a @ w)
                b = a * (n / np.maximum(r, floor) if floor else n)[:, None]
                out += np.concatenate([(b.T @ a).ravel(), b.T @ y, [n @ r]])
            return out

        s = summed(rows, step, e * e + e + 1) / n
        loss = s[-1] + float(w @ reg @ w) / 2
        if loss < least:
            least, best = loss, w
        if scale is None:
            scale = s[-1]
        if scale == 0:
            break
        new = np.linalg.lstsq(s[: e * e].reshape(e, e) + (reg if floor else 0), s[e * e : -1], rcond=None)[0]
        last = floor is not None and floor <= 1e-6 * scale
        floor = max(1e-6 * scale, floor * 0.4) if floor else 0.5 * scale
        if last and np.abs(new - w).max() <= close * max(1.0, np.abs(w).max()):
            break
        w = new
    return Linear(best[:-1], float(best[-1]))


def predict_counts(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))


def boosted(train: DataFrame, target: str, kind: str = "binary", trees: int = 20, depth: int = 4):
    """Boosted trees: a classifier, or under Poisson loss a model of counts (boosting.fit_poisson_trees)."""
    if kind == "binary":
        return GBTClassifier(labelCol=target, maxIter=trees, maxDepth=depth, seed=42).fit(train)
    return fit_poisson_trees(train, target, trees=trees, depth=depth)


def fit_component(df: DataFrame, gold: DataFrame, labels: list[str], blocks: dict[str, list[str]], sets: list[str], cs: list[float]) -> DataFrame:
    """(feature_set, c, val_micro_f1, threshold): every arm fitted on train and tuned on val only; best first."""
    from .calibrate import tune_threshold

    rows = None
    g = gold.select("row_id", "label").distinct().withColumn("y", F.lit(1))
    for name in sets:
        x = feature_set(name, blocks).fit(df).transform(df)
        for c in cs:
            models = fit_ovr(x.where("split = 'train'"), gold, labels, c)
            val = score_ovr(models, x.where("split = 'val'")).join(g, ["row_id", "label"], "left").fillna(0, ["y"])
            one = tune_threshold(val).select(F.lit(name).alias("feature_set"), F.lit(c).alias("c"), F.col("micro_f1").alias("val_micro_f1"), F.col("thr").alias("threshold"))
            rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy(F.desc("val_micro_f1"), "feature_set", "c")


def permuted(df: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """df with a group of columns moved jointly to other rows by a seeded hash order.

    Rows are ranked by row_id and by hash inside hash buckets of about 4,096 rows, and rank i of one order takes the
    values of rank i of the other, so buckets and not the whole table are sorted by a task."""
    from pyspark.sql import Window

    from ..functions.clean import hash_rank
    from ..sources.scratch import spread

    d = spread(df.withColumn("__b", F.pmod(F.xxhash64("row_id"), F.lit(max(1, df.count() // 4096)))), "__b")
    a = d.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("row_id")))
    b = d.select("__b", *(F.col(c).alias(f"__{c}") for c in cols), F.row_number().over(Window.partitionBy("__b").orderBy(hash_rank(seed, "row_id"), "row_id")).alias("__r"))
    j = a.join(b, ["__b", "__r"])
    return j.withColumns({c: F.col(f"__{c}") for c in cols}).select(*df.columns)


def permutation_report(df: DataFrame, groups: dict[str, list[str]], predict, gold: DataFrame, seed: int = 0) -> DataFrame:
    """(input, micro_f1, jaccard, delta_micro_f1): a fitted model's label sets with the columns of each group of inputs
    moved jointly to other rows, beside those of the untouched rows ("none").

    predict is a function of a frame that returns (row_id, label). Rows and gold labels are written once; a variant is
    predicted and counted in one pass."""
    from ..sources.scratch import stored
    from .metrics import set_metrics

    df, gold = stored(df), stored(gold.select("row_id", "label"))
    rows = df.select("row_id")
    out = None
    for name, cols in {"none": [], **groups}.items():
        one = set_metrics(rows, gold, predict(permuted(df, cols, seed) if cols else df)).select(F.lit(name).alias("input"), "micro_f1", "jaccard")
        out = one if out is None else out.unionByName(one)
    out = stored(out)
    base = out.where("input = 'none'").select(F.col("micro_f1").alias("__base"))
    return out.join(F.broadcast(base)).withColumn("delta_micro_f1", F.col("micro_f1") - F.col("__base")).drop("__base")  # one row


def permutation_importance(df: DataFrame, groups: dict[str, list[str]], score, seed: int = 42) -> DataFrame:
    """(group, base, permuted, drop): score is a function of a frame that returns a one-row frame with `score`."""
    base = score(df).select(F.col("score").alias("base"))
    out = None
    for name, cols in groups.items():
        one = score(permuted(df, cols, seed)).select(F.lit(name).alias("group"), F.col("score").alias("permuted")).join(F.broadcast(base))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("drop", F.col("base") - F.col("permuted"))
