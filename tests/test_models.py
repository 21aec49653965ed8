"""Fits that sum over tasks, against numpy on the same rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clinmill.operators import boosting, passes
from clinmill.operators import models as ML


def frame(spark, x, **cols):
    names = list(cols)
    rows = [(k, [float(v) for v in x[k]], *(float(cols[c][k]) for c in names)) for k in range(len(x))]
    df = spark.createDataFrame(rows, ", ".join(["row_id long", "f array<double>", *(f"{c} double" for c in names)]))
    return df.withColumn("features", array_to_vector("f")).drop("f").repartition(3)


def newton(x, y, reg):
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    r = np.diag(np.append(np.full(x.shape[1], reg), 0.0))
    for _ in range(60):
        q = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a / len(x) + r, a.T @ (q - y) / len(x) + r @ w)
    return w


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (300, 4)) * (r.random((300, 4)) < 0.6)
    ys = {f"l{k}": (x @ r.normal(0, 2, 4) + r.normal(0, 1, 300) > k - 1).astype(float) for k in range(4)} | {"never": np.zeros(300)}
    sparse = spark.createDataFrame([(k, Vectors.sparse(4, [(j, float(v)) for j, v in enumerate(x[k]) if v]) if k % 3 else Vectors.dense(x[k].tolist())) for k in range(300)], ["row_id", "features"])
    gold = spark.createDataFrame([(k, n) for n, y in ys.items() for k in range(300) if y[k]], "row_id long, label string")
    return x, ys, sparse.repartition(3), gold


@pytest.mark.parametrize("narrow", [ML.NARROW, 0])
def test_all_labels_at_once_equal_each_alone(spark, labelled, monkeypatch, narrow):
    """Newton steps and L-BFGS, dense and sparse vectors, to 1e-5 of the coefficients of each label's own fit."""
    x, ys, df, gold = labelled
    monkeypatch.setattr(ML, "NARROW", narrow)
    jobs = []
    monkeypatch.setattr(ML, "summed", lambda rows, step, size: jobs.append(1) or passes.summed(rows, step, size))
    m = ML.fit_ovr(df, gold, list(ys), 2.0)
    assert m.fitted.tolist() == [True] * 4 + [False]
    for k, y in enumerate(list(ys.values())[:4]):
        assert np.abs(m.coefficients[:, k] - newton(x, y, 1 / 600)).max() < 1e-5
    many = len(jobs)
    jobs.clear()
    ML.fit_ovr(df, gold, ["l1"], 2.0)
    assert many <= 2 * len(jobs) + 8  # jobs don't grow with the labels
    got = {(s["row_id"], s["label"]): s["p"] for s in ML.score_ovr(m, df).collect()}
    assert len(got) == 1500 and {got[k, "never"] for k in range(300)} == {0.0}
    w = newton(x, ys["l2"], 1 / 600)
    assert max(abs(got[k, "l2"] - 1 / (1 + np.exp(-(x[k] @ w[:-1] + w[-1])))) for k in range(300)) < 1e-5


def test_separable_and_empty_labels(spark):
    x = np.array([[v] for v in (-2.0, -1.0, 1.0, 2.0)])
    df = frame(spark, x)
    gold = spark.createDataFrame([(2, "pos"), (3, "pos"), (0, "all"), (1, "all"), (2, "all"), (3, "all"), (99, "elsewhere")], "row_id long, label string")
    m = ML.fit_ovr(df, gold, ["pos", "all", "elsewhere"], 1.0)
    assert m.fitted.tolist() == [True, True, False]
    p = {(s["row_id"], s["label"]): s["p"] for s in ML.score_ovr(m, df).collect()}
    assert p[0, "pos"] < 0.3 and p[3, "pos"] > 0.7 and p[0, "all"] > 0.99
    assert np.abs(m.coefficients[:, 0] - newton(x, np.array([0.0, 0, 1, 1]), 0.25)).max() < 1e-5


def lad(x, y, strength):
    """A plain fit by the same criterion, from many steps of reweighting with a tiny floor."""
    a = np.hstack([x, np.ones((len(x), 1))])
    r = np.diag(np.append(np.full(x.shape[1], strength), 0.0)) * len(x)
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    for k in range(400):
        b = a / np.maximum(np.abs(y - a @ w), max(1e-7, 0.9**k))[:, None]
        w = np.linalg.solve(b.T @ a + r, b.T @ y)
    return w, np.abs(y - a @ w).mean() + strength / 2 * (w[:-1] ** 2).sum()


@pytest.mark.parametrize("strength", [0.0, 0.05])
def test_least_absolute_deviations(spark, strength):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (301, 3))
    y = x @ np.array([2.0, -1.0, 0.5]) + 1 + r.standard_t(2, 301)
    m = ML.count_model(frame(spark, x, n=y), "n", "lad", strength)
    w, value = lad(x, y, strength)
    mine = np.append(m.coefficients, m.intercept)
    a = np.hstack([x, np.ones((301, 1))])
    assert np.abs(y - a @ mine).mean() + strength / 2 * (m.coefficients**2).sum() <= value * (1 + 1e-6)
    assert np.abs(mine - w).max() < 2e-3
    got = {s["row_id"]: s["prediction"] for s in ML.predict_counts(m, frame(spark, x, n=y)).collect()}
    assert max(abs(got[k] - max(0.0, float(a[k] @ mine))) for k in range(301)) < 1e-9


def test_outliers_move_least_squares_and_not_the_median(spark):
    """How far some rows lie off, on the side where they lie, is nothing to absolute deviations."""
    r = np.random.default_rng(2)
    x = np.arange(60.0)[:, None] / 10
    y = 3 + 2 * x[:, 0] + r.normal(0, 1, 60)

    def fits(far):
        worn = y.copy()
        worn[38:46] += far
        df = frame(spark, x, n=worn)
        both = ML.count_model(df, "n", "lad", 0.0), ML.count_model(df, "n", "ridge", 0.0)
        return [np.append(np.asarray(m.coefficients), m.intercept) for m in both]

    (near, ridge_near), (off, ridge_off) = fits(5.0), fits(500.0)
    assert np.abs(near - off).max() < 1e-3 and np.abs(ridge_near - ridge_off).max() > 10


def test_huber_and_constant_targets(spark):
    x = np.random.default_rng(1).normal(0, 1, (80, 2))
    y = x @ np.array([1.0, 2.0]) + 0.5
    m = ML.count_model(frame(spark, x, n=y), "n", "huber", 0.0)
    assert m.coefficients.toArray() == pytest.approx([1.0, 2.0], abs=1e-3)
    c = ML.count_model(frame(spark, x, n=np.full(80, 4.0)), "n", "lad", 0.0)
    assert np.abs(c.coefficients).max() < 1e-9 and c.intercept == pytest.approx(4.0)


def plain_trees(x, y, trees, depth, rate, bins, least, l2):
    """Boosting by loops over nodes, features and cuts."""
    edges = [np.unique(np.quantile(c[~np.isnan(c)], [k / bins for k in range(1, bins)])) for c in x.T]
    b = np.stack([np.where(np.isnan(c), len(e) + 1, np.searchsorted(e, c, "left")) for c, e in zip(x.T, edges, strict=True)], 1)
    raw = np.full(len(y), np.log(y.mean()))
    for _ in range(trees):
        g, h = np.exp(raw) - y, np.exp(raw)
        value = np.zeros(len(y))

        def grow(rows, level, g=g, h=h, value=value):
            value[rows] = -g[rows].sum() / (h[rows].sum() + l2)
            if level == depth:
                return
            best = (1e-12, None)
            score = lambda r, g=g, h=h: g[r].sum() ** 2 / (h[r].sum() + l2)
            for f in range(x.shape[1]):
                for cut in range(bins):
                    left, right = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
                    if min(len(left), len(right)) >= least:
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1]:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)

        grow(np.arange(len(y)), 0)
        raw = raw + rate * value
    return np.exp(raw)


def deviance(y, mu):
    return 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0) - (y - mu)).mean()


def test_poisson_trees_equal_plain_boosting(spark):
    """The same predictions as loops in numpy, missing values too, and less deviance than a line on interactions."""
    r = np.random.default_rng(3)
    x = np.round(r.normal(0, 1, (600, 3)), 2)
    y = r.poisson(np.exp(0.3 + 1.2 * ((x[:, 0] > 0) ^ (x[:, 1] > 0)))).astype(float)
    x[::17, 2] = np.nan
    df = frame(spark, x, n=y)
    m = boosting.fit_poisson_trees(df, "n", trees=7, depth=3, rate=0.3, bins=8, least=10)
    got = {s["row_id"]: s["prediction"] for s in m.transform(df).collect()}
    want = plain_trees(x, y, 7, 3, 0.3, 8, 10, 1.0)
    assert max(abs(got[k] - want[k]) for k in range(600)) < 1e-9
    from pyspark.ml.regression import GeneralizedLinearRegression

    filled = frame(spark, np.nan_to_num(x), n=y)
    line = GeneralizedLinearRegression(labelCol="n", family="poisson", link="log").fit(filled)
    flat = {s["row_id"]: s["prediction"] for s in line.transform(filled).collect()}
    assert deviance(y, np.array([got[k] for k in range(600)])) < 0.8 * deviance(y, np.array([flat[k] for k in range(600)]))


def test_poisson_trees_of_odd_tables(spark):
    x = np.ones((30, 2))
    df = frame(spark, x, n=np.arange(30) % 3)
    m = ML.boosted(df, "n", "poisson", trees=2, depth=2)
    assert {round(s["prediction"], 9) for s in m.transform(df).collect()} == {1.0}
    assert {s["prediction"] for s in ML.boosted(frame(spark, x, n=np.zeros(30)), "n", "poisson", trees=2).transform(df).collect()} == {0.0}
    assert ML.boosted(df.limit(0), "n", "poisson", trees=2).transform(df).count() == 30


def test_forward_in_time_criterion(spark):
    """ML-6: what is fitted on earlier years is scored on the later one only, at the best threshold."""
    from clinmill.operators.calibrate import tune_threshold

    r = np.random.default_rng(9)
    x = r.normal(0, 1, (400, 2))
    year = np.repeat([1997.0, 1998.0, 1999.0, 2000.0], 100)
    y = x[:, 0] + 0.3 * r.normal(0, 1, 400) > 0
    y[300:] = ~y[300:]  # a later year that would spoil both fit and score
    df = frame(spark, x, year=year)
    gold = spark.createDataFrame([(k, "a") for k in range(400) if y[k]], "row_id long, label string")
    m = ML.fit_ovr(df.where("year <= 1998"), gold, ["a"])
    w = newton(x[:200], y[:200].astype(float), 1 / 200)
    assert np.abs(m.coefficients[:, 0] - w).max() < 1e-5
    p = ML.score_ovr(m, df.where("year = 1999")).join(gold.withColumn("y", F.lit(1)), ["row_id", "label"], "left").fillna(0, ["y"])
    best = tune_threshold(p).first()
    q = 1 / (1 + np.exp(-(x[200:300] @ w[:-1] + w[-1])))
    f1 = lambda t: 2 * (y[200:300] & (q >= t)).sum() / ((q >= t).sum() + y[200:300].sum())
    assert best["micro_f1"] == pytest.approx(f1(best["thr"]), abs=1e-6) and best["micro_f1"] > 0.85


def test_rows_that_agree_are_packed_once(spark):
    """Blocks hold each row of a task once, with the weights of all rows that agree; sparse and dense; the sums stay."""
    x = np.repeat([[1.0, 0.0, 2.0], [0.0, 3.0, 0.0]], [40, 60], 0)
    df = frame(spark, x, y=np.repeat([1.0, 0.0], [40, 60])).coalesce(1)
    rows, d = passes.packed(passes.vectors(df, "features", F.array("y").alias("y")).withColumn("n", F.lit(1.0)))
    assert d == 3
    got = rows.toPandas()
    assert got["rows"].sum() == 2
    (r, of, y, n), = passes.opened(got, 3)
    assert sorted(n) == [40, 60] and n @ y[of] == 40 and np.allclose(r.tdot(n[:, None]).ravel(), [*x.sum(0), 100])
    sparse = spark.createDataFrame([(Vectors.sparse(3, [(1, 2.0)]),)] * 5 + [(Vectors.dense(1.0, 0.0, 0.0),)] * 2 + [(Vectors.sparse(3, []),)] * 3, ["features"]).coalesce(1)
    rows, _ = passes.packed(passes.vectors(sparse, "features", F.array().cast("array<double>").alias("y")).withColumn("n", F.lit(1.0)))
    (r, of, y, n), = passes.opened(rows.toPandas(), 3)
    assert r.n == 3 and not len(y) and r.tdot(n[:, None]).ravel().tolist() == [2.0, 10.0, 0.0, 10.0]


def test_narrow_vectors_are_taken_as_a_matrix():
    """Dense and narrow sparse vectors of a batch become one matrix, without a step per row."""
    import pyarrow as pa

    kinds = pa.schema([("xn", pa.int32()), ("xi", pa.list_(pa.int32())), ("xv", pa.list_(pa.float64()))])
    batch = lambda *rows: pa.RecordBatch.from_pylist([dict(zip(("xn", "xi", "xv"), r, strict=True)) for r in rows], kinds)
    got = passes.matrix(batch((None, None, [1.0, 2.0, 3.0]), (3, [0, 2], [4.0, 5.0]), (3, [], [])))
    assert got.tolist() == [[1, 2, 3], [4, 0, 5], [0, 0, 0]]
    assert passes.matrix(batch((1000, [999], [1.0]))) is None and passes.matrix(batch((None, None, [1.0]), (None, None, [1.0, 2.0]))) is None


def test_blocks_of_different_rows_keep_all(spark):
    """More rows than a block holds, with labels of several sizes: nothing is lost or mixed up."""
    n = passes.ENTRIES // 4 + 5000
    df = spark.range(n).coalesce(1).select(F.lit(None).cast("int").alias("xn"), F.lit(None).cast("array<int>").alias("xi"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("xv"), F.slice(F.array(F.col("id") * 1.0, F.col("id") * 2.0), F.lit(1), (F.col("id") % 3).cast("int")).alias("y"), F.lit(2.0).alias("n"))
    rows, d = passes.packed(df)
    at, ys, weight = [], [], 0.0
    for r, of, y, w in passes.opened(rows.toPandas(), d):
        at += r.full[:, 0].tolist()
        ys += list(zip(r.full[of, 0], y, strict=True))
        weight += w.sum()
    assert d == 2 and sorted(at) == list(range(n)) and weight == 2.0 * n
    assert sorted(ys) == sorted([(k, float(k)) for k in range(n) if k % 3 > 0] + [(k, 2.0 * k) for k in range(n) if k % 3 == 2])


def test_threshold_curve_reads_its_rows_once(spark):
    from clinmill.operators.calibrate import threshold_curve

    p = spark.range(100).select((F.col("id") / 100).alias("p"), (F.col("id") % 2).alias("y")).mapInPandas(lambda it: it, "p double, y long")
    c = threshold_curve(p, [], [0.25, 0.5])
    assert sorted(map(tuple, c.select("thr", "n_gold", "tp", "n_pred").collect())) == [(0.25, 50, 38, 75), (0.5, 50, 25, 50)]
    assert c._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert threshold_curve(p.where("p > 2"), [], [0.25, 0.5]).count() == 0
