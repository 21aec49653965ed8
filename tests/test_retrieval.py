"""Retrieval, groups, bootstrap, calibration and models against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clinmill.operators import assemble as A
from clinmill.operators import calibrate as CA
from clinmill.operators import concepts as CO
from clinmill.operators import features as FE
from clinmill.operators import graph
from clinmill.operators import metrics as EV
from clinmill.operators import models as ML
from clinmill.operators import retrieve as R


@pytest.fixture(scope="module")
def sides(spark):
    r = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    make = lambda n, first: [(first + k, [float(x) for x in r.normal(0, 1, 6)] if k % 11 else None, [(w, float(abs(r.normal()))) for w in sorted(set(r.choice(words, r.integers(0, 9))))]) for k in range(n)]
    q, t = make(70, 0), make(90, 500)
    unit = lambda rows: [(i, v, [(w, x / math.sqrt(sum(y * y for _, y in ts))) for w, x in ts]) for i, v, ts in rows]
    q, t = unit(q), unit(t)

    def frame(rows, key):
        d = spark.createDataFrame([(i, v) for i, v, _ in rows], f"{key} long, vec array<double>")
        w = spark.createDataFrame([(i, a, b) for i, _, ts in rows for a, b in ts], "row_id long, term string, w double")
        return R.with_terms(d, w, key)

    return q, t, frame(q, "qid"), frame(t, "rid")


@pytest.mark.parametrize("alpha", [0.0, 0.4, 1.0])
def test_block_topk(sides, monkeypatch, alpha):
    q, t, qd, td = sides
    monkeypatch.setattr(R, "BLOCK", 32)

    def score(a, b):
        sem = 0.0 if a[1] is None or b[1] is None else float(np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]))
        lex = sum(x * dict(b[2]).get(w, 0.0) for w, x in a[2])
        return round(alpha * sem + (1 - alpha) * lex, 9)

    got: dict = {}
    for r in R.block_topk(qd, td, 4, alpha).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["rid"], r["score"])
    assert len(got) == len(q)
    for a in q:
        want = sorted(((-score(a, b), b[0]) for b in t))[:4]
        assert [got[a[0]][k + 1][1] for k in range(4)] == pytest.approx([-s for s, _ in want], abs=1e-8)
        assert [got[a[0]][k + 1][0] for k in range(4)] == [i for _, i in want]


def test_cosine_topk_takes_both_ways(sides, monkeypatch):
    _, _, q, t = sides
    q, t = q.where("vec is not null").select("qid", "vec"), t.where("vec is not null").select("rid", "vec")
    small = sorted((r["qid"], r["rank"], r["rid"]) for r in A.cosine_topk(q, t, 3).collect())
    monkeypatch.setattr(A, "if_small", lambda table, most: None)
    assert small == sorted((r["qid"], r["rank"], r["rid"]) for r in A.cosine_topk(q, t, 3).collect())


def test_pivot_topk_skips_cells_and_stays_exact(spark, monkeypatch):
    """Tight clusters, copies (ties), null, zero and short vectors; the rows of all pairs, with most pairs of cells skipped."""
    monkeypatch.setattr(R, "BLOCK", 24)
    r = np.random.default_rng(5)
    centre = r.normal(0, 1, (8, 12))
    vec = lambda k: (centre[k % 8] + r.normal(0, 0.05, 12)).tolist()
    refs = [(1000 + k, vec(k)) for k in range(300)]
    refs += [(2000 + k, list(refs[k][1])) for k in range(12)] + [(3000, None), (3001, [0.0] * 12), (3002, [1.0, 2.0])]
    asks = [(k, vec(k)) for k in range(60)] + [(70, None), (71, [0.0] * 12), (72, refs[3][1]), (73, (-centre.sum(0)).tolist())]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, vec array<double>").repartition(3)
    out, skipped = R.pivot_topk(frame(asks, "qid"), frame(refs, "rid"), 4)
    got: dict = {}
    for x in out.collect():
        got.setdefault(x["qid"], {})[x["rank"]] = (x["rid"], x["score"])
    unit = lambda v: np.zeros(12) if v is None or not np.any(v) else np.pad(np.array(v, float), (0, 12 - len(v))) / np.linalg.norm(v)
    for i, v in asks:
        want = sorted((-round(float(unit(v) @ unit(w)), 9) + 0.0, j) for j, w in refs)[:4]
        assert [got[i][n + 1][1] for n in range(4)] == pytest.approx([-s for s, _ in want], abs=2e-9), i
        assert [got[i][n + 1][0] for n in range(4)] == [j for _, j in want], i
    assert skipped > 0.3
    few, _ = R.pivot_topk(frame(asks[:5], "qid"), frame(refs[:2], "rid"), 4)
    assert few.count() == 10


def test_knn_vote(sides, spark):
    q, t, _, _ = sides
    long = lambda rows: spark.createDataFrame([(i, a, b) for i, _, ts in rows for a, b in ts], "row_id long, term string, w double")
    gold = {i: {f"g{i % 3}", f"h{i % 2}"} for i, _, _ in t}
    g = spark.createDataFrame([(i, x) for i, s in gold.items() for x in s], "row_id long, label string")
    got = {(r["row_id"], r["label"]): r["votes"] for r in A.knn_label_vote(long(t), long(q), g).collect()}
    want = {}
    for i, _, ts in q:
        if not ts:
            continue
        s = sorted((-round(sum(x * dict(b[2]).get(w, 0.0) for w, x in ts), 9), b[0]) for b in t if b[2])[:5]
        near = [r for v, r in s if v < 0]
        for x in {x for r in near for x in gold[r]}:
            n = sum(x in gold[r] for r in near)
            if n >= 2:
                want[i, x] = n
    assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_sparse_topk_against_all_pairs(spark, monkeypatch, small):
    """Frequent and rare terms, near copies, ties, rows without shared terms; small blocks and short first bounds too."""
    if small:
        for name, value in (("INDEX", 16), ("VISIT", 8), ("FIRST", 2), ("SHORT", 6)):
            monkeypatch.setattr(R, name, value)
    r = np.random.default_rng(8)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]

    def row():
        ts = {*r.choice(common, 6).tolist(), *r.choice(rare, 10).tolist()}
        return {t: 1.0 if t[0] == "c" else float(4 + r.random()) for t in ts}

    refs = [row() for _ in range(150)]
    refs += [dict(refs[k]) for k in range(20)]  # copies: ties
    refs += [{**refs[k], "extra": 2.0} for k in range(20, 40)]
    asks = [dict(refs[k]) for k in range(0, 60, 2)] + [row() for _ in range(30)] + [{"nowhere": 1.0}, {"c1": 1.0}, {f"x{k}": 1.0 for k in range(3)} | {"r1": 0.5}]
    unit = lambda d: {t: w / math.sqrt(sum(x * x for x in d.values())) for t, w in d.items()}
    refs, asks = [unit(d) for d in refs], [unit(d) for d in asks]
    frame = lambda rows, key, first: spark.createDataFrame([(first + k, t, w) for k, d in enumerate(rows) for t, w in d.items()], f"{key} long, term string, w double")
    got: dict = {}
    for x in R.sparse_topk(frame(asks, "qid", 0), frame(refs, "rid", 1000), 5).collect():
        got.setdefault(x["qid"], {})[x["rank"]] = (x["rid"], x["score"])
    for k, a in enumerate(asks):
        s = sorted((-round(sum(w * b.get(t, 0.0) for t, w in a.items()), 9), 1000 + j) for j, b in enumerate(refs))
        want = [(j, -v) for v, j in s[:5] if v < 0]
        mine = [got.get(k, {})[i + 1] for i in range(len(got.get(k, {})))]
        assert [v for _, v in mine] == pytest.approx([v for _, v in want], abs=2e-9), k
        assert [j for j, _ in mine] == [j for j, _ in want] or len({v for _, v in want}) < len(want), k
    assert 90 not in got or got[90] == {}


def test_index_stops_early_and_stays_exact():
    r = np.random.default_rng(3)
    terms = [np.unique(r.integers(0, 300, 30)) for _ in range(500)]
    weights = [r.random(len(t)) + 0.1 for t in terms]
    index = R.Index(np.arange(500)[::-1].copy(), terms, weights)
    rid = np.arange(500)[::-1]
    for _ in range(40):
        t = np.unique(r.integers(0, 320, 25))
        w = r.random(len(t)) + 0.1
        full = np.array([sum(w[np.searchsorted(t, x)] * y for x, y in zip(a, b, strict=True) if x in set(t.tolist())) for a, b in zip(terms, weights, strict=True)])
        full = np.round(full, 9)
        order = np.lexsort((rid, -full))[:5]
        for least in (0.0, float(np.sort(full)[-5]), float(np.sort(full)[-9])):
            rows, scores = index.best(t, w, 5, least)
            assert index.rids[rows].tolist() == rid[order].tolist() and scores == pytest.approx(full[order], abs=2e-9)


@pytest.mark.parametrize("hot", [1 << 18, 25])
def test_texts_meet_without_copies(spark, monkeypatch, hot):
    """All pairs of texts of one, several and no rows an id; pairs of blocks are neither shuffled nor copied, with frequent terms alone in every task too."""
    for name, value in (("HOT", hot), ("INDEX", 16), ("VISIT", 8), ("POSTINGS", 200)):
        monkeypatch.setattr(R, name, value)
    kept, write = [], R.stored
    monkeypatch.setattr(R, "stored", lambda d: kept.append(d) or write(d))
    r = np.random.default_rng(6)
    words = [f"w{k}" for k in range(80)]
    text = lambda: " ".join(r.choice(words, r.integers(1, 30), p=(x := 1 / np.arange(2, 82)) / x.sum()))
    rows = [(k, text()) for k in range(150)] + [(k, text()) for k in range(30)] + [(None, text()), (500, ""), (505, None), (601, "nowhere else"), (600, "nowhere else")]
    held: dict = {}
    for k, v in rows:
        if k is not None and v:
            held.setdefault(k, []).extend(set(v.split()))
    train = {k: v for k, v in held.items() if k % 5}
    df = {t: sum(t in v for v in train.values()) for t in {t for v in held.values() for t in v}}
    idf = {t: math.log((1 + len(train)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}
    weigh = lambda v: {t: (1 + math.log(v.count(t))) * idf[t] for t in set(v) if t in idf}
    unit = lambda d: {t: x / math.sqrt(sum(y * y for y in d.values())) for t, x in d.items()}
    w = {k: unit(weigh(v)) for k, v in held.items()}
    docs = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got: dict = {}
    for x in R.texts_topk(docs, F.split("text", " "), F.expr("id % 5 > 0"), F.expr("id % 5 = 0"), 4, 2).collect():
        got.setdefault(x["qid"], {})[x["rank"]] = (x["rid"], x["score"])
    for k in w:
        if k % 5 == 0:
            want = [(-v, j) for v, j in sorted((-round(sum(x * w[j].get(t, 0.0) for t, x in w[k].items()), 9), j) for j in train) if v < 0][:4]
            mine = [got.get(k, {})[i + 1] for i in range(len(got.get(k, {})))]
            assert [v for _, v in mine] == pytest.approx([v for v, _ in want], abs=2e-9), k
            assert [j for j, _ in mine] == [j for _, j in want], k
    pairs, = (d._jdf.queryExecution().executedPlan().toString() for d in kept if d.columns == ["qid", "rid", "score"])
    assert "CartesianProduct" in pairs and "Exchange" not in pairs and "Generate" not in pairs
    assert len(kept) == (5 if hot > 25 else 6)


def test_groups_and_concepts(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    r = np.random.default_rng(2)
    centre = r.normal(0, 1, (6, 8))
    rows = [(f"p{k:03d}", int(r.integers(1, 30)), [float(x) for x in centre[k % 6] + 0.35 * r.normal(0, 1, 8)]) for k in range(90)]
    df = spark.createDataFrame(rows, "phrase string, freq long, vec array<double>")
    unit = np.array([v for _, _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = np.round(unit @ unit.T, 9) >= 0.8
    up = list(range(90))
    for _ in range(90):
        up = [min(up[j] for j in np.flatnonzero(near[k])) for k in range(90)]
    got = {x["id"]: x["comp"] for x in R.similarity_groups(df.select(F.col("phrase").alias("id"), "vec"), 0.8).collect()}
    assert got == {rows[k][0]: rows[up[k]][0] for k in range(90)}
    c = CO.induce_concepts(df, tau=0.8, support=25).collect()
    for root in set(up):
        mine = [k for k in range(90) if up[k] == root]
        total = sum(rows[k][1] for k in mine)
        have = [x for x in c if x["phrase"] == rows[root][0]]
        assert bool(have) == (total >= 25)
        if have:
            best = max((rows[k][1], rows[k][0]) for k in mine)
            cent = sum(rows[k][1] * np.array(rows[k][2]) for k in mine) / total
            assert have[0]["support"] == total and have[0]["label"] == best[1] and have[0]["centroid"] == pytest.approx(cent)
    spans = spark.createDataFrame([(1, rows[0][0], rows[0][2]), (2, "new", [float(x) for x in centre[1]]), (3, "far", [float(x) for x in -centre.sum(0)])], "key long, phrase string, vec array<double>")
    cs = CO.induce_concepts(df, tau=0.8, support=25)
    cents = {x["concept"]: np.array(x["centroid"]) for x in c}
    own = {x["phrase"]: x["concept"] for x in c}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for tau in (0.5, 0.8, 0.999):
        a = {x["key"]: (x["concept"], x["how"]) for x in CO.assign_concepts(spans, cs, tau).collect()}
        for key, phrase, vec in spans.collect():
            best = max(((cos(np.array(vec), v), -k) for k, v in cents.items()))
            want = (own[phrase], "exact") if phrase in own else (-best[1], "centroid") if best[0] >= tau else None
            assert a.get(key) == want


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(90)]
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {x["id"]: x["comp"] for x in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: c for x, c in up.items() if x in got} and all(up[x] == x for x in set(up) - set(got))


def test_bootstrap_has_the_spread_of_resampling(spark):
    """The interval of drawn kinds of rows is that of resampled rows."""
    r = random.Random(4)
    rows = []
    for k in range(3000):
        g, p = r.randint(0, 3), r.randint(0, 3)
        rows.append((k, "a", r.randint(0, min(g, p)), p, g))
        rows.append((k, "b", r.randint(0, min(g, p)), p, g))
    df = spark.createDataFrame(rows, "row_id long, system string, tp long, n_pred long, n_gold long")
    got = EV.bootstrap(df, ["system"], 1000, 3).toPandas()
    d = EV.delta_stats(spark.createDataFrame(got[got.system == "a"]), spark.createDataFrame(got[got.system == "b"]), "micro_f1", relative=True).first()
    x = np.array([(a[2], b[2], a[3] + a[4]) for a, b in zip(rows[::2], rows[1::2], strict=True)], float)
    rng = np.random.default_rng(0)
    reps = []
    for _ in range(1000):
        s = x[rng.integers(0, len(x), len(x))].sum(0)
        reps.append((2 * s[0] / s[2], 2 * s[1] / s[2]))
    reps = np.array(reps)
    assert got[got.system == "a"].micro_f1.std() == pytest.approx(reps[:, 0].std(), rel=0.15)
    diff = reps[:, 0] - reps[:, 1]
    assert d["hi95"] - d["lo95"] == pytest.approx(np.quantile(diff, 0.975) - np.quantile(diff, 0.025), rel=0.15)
    assert len(got) == 2000


def test_weights_are_poisson_sums(spark):
    """Whole numbers of at least 0 with the distribution of summed Poisson(1) weights, of one row and of many."""
    for m in (1, 2, 30, 256, 257, 5000):
        w = np.concatenate([EV.kind_weights(f"{m}:{k}", m, 1000, 5) for k in range(40)])
        assert (w == np.rint(w)).all() and w.min() >= 0 and len(w) == 40_000
        assert w.mean() == pytest.approx(m, abs=5 * math.sqrt(m / 40_000))
        assert w.var() == pytest.approx(m, rel=0.05)
        skew = ((w - w.mean()) ** 3).mean() / w.std() ** 3
        assert skew == pytest.approx(1 / math.sqrt(m), abs=0.08)
    w = EV.kind_weights("x", 1, 100_000, 1)
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.006)
    assert (EV.kind_weights("x", 3, 10, 1) == EV.kind_weights("x", 3, 12, 1)[:10]).all()


def test_bootstrap_of_kinds_of_one_row(spark):
    """Every row a kind of its own: replicates are those of the weights, and none has a negative part."""
    rows = [(k, k % 7, 7 + k, 9 + 2 * k) for k in range(60)]
    df = spark.createDataFrame(rows, "row_id long, tp long, n_pred long, n_gold long")
    got = {x["b"]: x["micro_f1"] for x in EV.bootstrap(df, [], 50, 2).collect()}
    w = np.array([EV.kind_weights(f"{t}:{p}:{g}", 1, 50, 2) for _, t, p, g in rows])
    t, p, g = (np.array([r[i] for r in rows], float) @ w for i in (1, 2, 3))
    assert got == pytest.approx({b: 2 * t[b] / (p[b] + g[b]) for b in range(50)})


def test_isotonic_is_pool_adjacent_violators(spark):
    r = np.random.default_rng(5)
    p = np.round(r.random(400), 2)
    y = (r.random(400) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    xs = np.unique(p)
    pools = [[float(y[p == v].mean()), int((p == v).sum()), [v]] for v in xs]
    k = 0
    while k + 1 < len(pools):
        if pools[k][0] >= pools[k + 1][0]:
            a, b = pools[k], pools.pop(k + 1)
            pools[k] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            k = max(k - 1, 0)
        else:
            k += 1
    knots = [(v, m) for m, _, vs in pools for v in (vs[0], vs[-1])]
    grid = [0.0, 0.137, 0.333, 0.5, 0.501, 0.87, 1.0]
    got = {x["p"]: x["p_cal"] for x in CA.calibrate(df, spark.createDataFrame([(g,) for g in grid], "p double"), "isotonic").collect()}
    want = np.interp(grid, [a for a, _ in knots], [b for _, b in knots])
    assert [got[g] for g in grid] == pytest.approx(want.tolist(), abs=1e-9)


def test_ovr_is_l2_logistic(spark):
    """Against Newton steps in numpy; a label without positives scores 0."""
    r = np.random.default_rng(6)
    x = r.normal(0, 1, (300, 3))
    y = (x @ np.array([1.0, -2.0, 0.5]) + r.normal(0, 1, 300) > 0).astype(float)
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(300)], "row_id long, f array<double>").select("row_id", array_to_vector("f").alias("features"))
    gold = spark.createDataFrame([(k, "yes") for k in range(300) if y[k]], "row_id long, label string")
    got = {(s["row_id"], s["label"]): s["p"] for s in ML.score_ovr(ML.fit_ovr(df, gold, ["yes", "never"], 1.0), df).collect()}
    a, w = np.hstack([x, np.ones((300, 1))]), np.zeros(4)
    reg = np.diag([1.0, 1.0, 1.0, 0.0]) / 300
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a / 300 + reg, a.T @ (q - y) / 300 + reg @ w)
    want = 1 / (1 + np.exp(-a @ w))
    assert max(abs(got[k, "yes"] - want[k]) for k in range(300)) < 2e-3
    assert {got[k, "never"] for k in range(300)} == {0.0}
    m = {(s["row_id"], s["label"]): (s["p"], s["best"]) for s in ML.multiclass(spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.6), (2, "a", 0.0), (2, "b", 0.0)], "row_id long, label string, p double")).collect()}
    assert m[1, "a"][0] == pytest.approx(0.25) and m[1, "b"][1] == "b" and m[2, "a"][0] == 0.5


def test_counts_are_ridge_and_clipped(spark):
    r = np.random.default_rng(7)
    x = r.normal(0, 1, (200, 2))
    y = np.maximum(0, np.round(1 + x @ np.array([2.0, -1.0])))
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame([(k, [float(v) for v in x[k]], float(y[k])) for k in range(200)], "row_id long, f array<double>, n double").withColumn("features", array_to_vector("f"))
    got = {s["row_id"]: s["prediction"] for s in ML.predict_counts(ML.count_model(df, "n", strength=0.0), df).collect()}
    a = np.hstack([x, np.ones((200, 1))])
    want = np.maximum(a @ np.linalg.lstsq(a, y, rcond=None)[0], 0)
    assert max(abs(got[k] - want[k]) for k in range(200)) < 1e-6 and min(got.values()) == 0.0


def test_permutation_report(spark):
    """A model that reads one column only loses by that column, and by all of them."""
    df = spark.createDataFrame([(k, float(k % 2), float(k % 7)) for k in range(600)], "row_id long, used double, unused double")
    gold = df.select("row_id", F.concat(F.lit("l"), F.col("used").cast("int").cast("string")).alias("label"))
    predict = lambda d: d.select("row_id", F.concat(F.lit("l"), F.col("used").cast("int").cast("string")).alias("label"))
    got = {r["input"]: r for r in ML.permutation_report(df, {"used": ["used"], "unused": ["unused"], "all": ["used", "unused"]}, predict, gold).collect()}
    assert got["none"]["micro_f1"] == 1.0 and got["unused"]["delta_micro_f1"] == 0.0
    assert got["used"]["delta_micro_f1"] < -0.2 and got["all"]["micro_f1"] == got["used"]["micro_f1"]
    moved = ML.permuted(df, ["used", "unused"], 0)
    assert sorted((r["used"], r["unused"]) for r in moved.collect()) == sorted((r["used"], r["unused"]) for r in df.collect())


def test_index_parts_grow_slower_than_rows():
    """Copies of a row, one for each part of the other side, stay few while blocks may grow."""
    assert [R._parts(n, 4096) for n in (1, 5_000, 40_000, 250_000, 600_000)] == [1, 2, 8, 8, 19]


def test_ablation(spark):
    from clinmill.operators.ablation import ARMS, ablation

    notes = [("htn", "c"), ("hypertension since 3 years", "c"), ("knee pain", "p"), ("lbp", "p"), ("fever", "f"), ("c/o htn", "c")]
    rows = [(k, "test" if k % 4 == 0 else "train", notes[(k // 4 + k) % 6][0]) for k in range(240)]
    gold = spark.createDataFrame([(k, notes[(k // 4 + k) % 6][1]) for k in range(240)], "row_id long, label string")
    got = {r["arm"]: r for r in ablation(spark.createDataFrame(rows, "row_id long, split string, note string"), "note", gold, ["c", "p", "f"], {k: ARMS[k] for k in ("raw", "glossary")}, n_boot=50).collect()}
    assert got["raw"]["delta"] == 0.0 and got["raw"]["micro_f1"] > 0.9 and got["glossary"]["micro_f1"] > 0.9
    assert got["raw"]["lo95"] == got["raw"]["hi95"] == 0.0


def test_ablation_runs_on_kinds_of_rows(spark, monkeypatch):
    """Models get a row for each split, note and label set, whatever the number of rows."""
    from clinmill.operators import ablation as AB

    notes = [("htn", "c"), ("knee pain", "p"), ("htn", "p"), ("knee pain", None)]
    rows = [(k, "test" if k % 3 == 0 else "train", notes[k // 3 % 4][0]) for k in range(240)]
    gold = spark.createDataFrame([(k, notes[k // 3 % 4][1]) for k in range(240) if notes[k // 3 % 4][1]], "row_id long, label string")
    seen = []
    fit = AB.fit_ovr
    monkeypatch.setattr(AB, "fit_ovr", lambda train, *a, **k: seen.append((train.count(), train.agg(F.sum("n")).first()[0])) or fit(train, *a, **k))
    got = AB.ablation(spark.createDataFrame(rows, "row_id long, split string, note string"), "note", gold, ["c", "p"], {"raw": AB.ARMS["raw"]}, n_boot=20).collect()
    assert seen == [(4, 160)] and len(got) == 1 and 0 < got[0]["micro_f1"] < 1


def test_finalise(spark):
    df = spark.createDataFrame([(["z", "b", "a"], ["a", "b"], "a", "low_confidence"), (["z"], ["a", "b"], "a", "confident"), ([], ["a"], "a", "low_confidence")], "codes array<string>, cand array<string>, top string, tier string")
    assert [r[0] for r in df.select(FE.finalise(F.col("codes"), F.col("cand"), F.col("top"), F.col("tier"))).collect()] == ["b", "a", None]


def test_svd(spark):
    r = np.random.default_rng(8)
    a = r.normal(0, 1, (80, 30)) * (r.random((80, 30)) < 0.3) * np.linspace(3, 0.2, 30)
    w = spark.createDataFrame([(i, f"t{j:02d}", float(a[i, j])) for i in range(80) for j in range(30) if a[i, j]], "row_id long, term string, w double")
    s, v = FE.svd_fit(w, 4)
    u, d, vt = np.linalg.svd(a)
    assert s == pytest.approx(d[:4], rel=1e-5)
    for k in range(3):
        assert abs(sum(v[f"t{j:02d}"][k] * vt[k, j] for j in range(30) if f"t{j:02d}" in v)) > 0.999


def test_calibrator_choice(spark):
    """The untouched method's error is the mean of plain calibration errors over the folds."""
    r = np.random.default_rng(9)
    p = r.random(600)
    y = (r.random(600) < p**3).astype(int)
    fold = np.arange(600) % 3
    df = spark.createDataFrame([(float(a), int(b), int(f)) for a, b, f in zip(p, y, fold, strict=True)], "p double, y int, f int")
    got = {x["method"]: x["ece"] for x in CA.select_calibrator(df, F.col("f"), 3).collect()}

    def ece(a, b):
        k = np.minimum(np.ceil(a * 10).astype(int) - 1, 9).clip(0)
        return sum(abs(a[k == j].mean() - b[k == j].mean()) * (k == j).mean() for j in set(k.tolist()))

    assert got["none"] == pytest.approx(np.mean([ece(p[fold == k], y[fold == k]) for k in range(3)]), abs=1e-9)
    assert got["isotonic"] < got["none"] and got["sigmoid"] < got["none"]


def test_text_features(spark):
    """Normalised text, spans and the flag, by hand."""
    from clinmill.plans import QUERIES  # noqa: F401
    from clinmill.functions import text as T

    notes = ["1. pain in abdomen 2. fever for 3 days", "rt knee pain, rt", "NO", "", None, "c/o SOB, chest pain for last 5 days"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(notes)], "k int, note string")
    got = {x["k"]: (x["s"], x["n"]) for x in df.select("k", T.segment("note").alias("s"), T.is_no_complaint("note").alias("n")).collect()}
    assert got == {0: (["pain in abdomen", "fever for 3 days"], False), 1: (["rt knee pain rt"], False), 2: ([], True), 3: ([], False), 4: ([], False), 5: (["c/o SOB", "chest pain for last 5 days"], False)}


def test_ids_are_digested_like_in_sql(spark):
    df = spark.createDataFrame([("Ã Â¦", "x"), ("ﬁne ১২", "y")], "t string, k string")
    from clinmill.functions import text as T

    assert [x[0] for x in df.where("k = 'y'").select(T.norm_text("t", compatible=True)).collect()] == ["fine 12"]


def test_fit_component_picks_the_arm_that_knows(spark):
    """Arms are fitted on train and tuned on val; scores of the best one against plain Python."""
    r = np.random.default_rng(10)
    rows = [(k, ["train", "train", "val"][k % 3], float(r.normal()), float(r.normal())) for k in range(360)]
    df = spark.createDataFrame(rows, "row_id long, split string, a double, b double")
    gold = spark.createDataFrame([(k, "pos") for k, _, _, b in rows if b > 0.2], "row_id long, label string")
    blocks, sets = {"text": ["a"], "physio": ["b"]}, ["text", "physio", "text+physio"]
    got = ML.fit_component(df, gold, ["pos"], blocks, sets, [1.0]).collect()
    assert len(got) == 3 and got[-1]["feature_set"] == "text" and got[0]["val_micro_f1"] > 0.95 > got[-1]["val_micro_f1"]
    best = got[0]
    x = ML.feature_set(best["feature_set"], blocks).fit(df).transform(df)
    p = {s["row_id"]: s["p"] for s in ML.score_ovr(ML.fit_ovr(x.where("split = 'train'"), gold, ["pos"], 1.0), x.where("split = 'val'")).collect()}
    y = {k: b > 0.2 for k, s, _, b in rows if s == "val"}

    def f1(t):
        tp, n = sum(y[k] for k in y if p[k] >= t), sum(p[k] >= t for k in y) + sum(y.values())
        return round(2 * tp / n, 9) if n else 0.0

    top = max(f1(t) for t in CA.GRID)
    assert best["val_micro_f1"] == pytest.approx(top) and best["threshold"] == min(t for t in CA.GRID if f1(t) == top)


def test_random_control_is_not_rounded(spark):
    """The control ranks by its whole value: a seventh decimal decides, against the order of row_id."""
    from clinmill.operators import abstain as AB

    counts = spark.createDataFrame([(1, 0, 1, 1, 0.12345601), (2, 1, 1, 1, 0.12345602), (3, 0, 1, 1, 0.12345603), (4, 1, 1, 1, 0.12345604)], "row_id long, tp long, n_pred long, n_gold long, c double")
    got = {r["signal"]: r["auc"] for r in AB.select_signal(counts, ["c"], F.col("c"), [0.25]).collect()}
    assert got == {"c": 0.0, "random": 1.0}


def test_curve_of_ties_ranks_ranges_only(spark):
    """Rows that all tie are cut by row_id, with as many ranges as their number asks for."""
    from clinmill.operators import abstain as AB

    counts = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") < 500).cast("long").alias("tp"), F.lit(1).cast("long").alias("n_pred"), F.lit(1).cast("long").alias("n_gold"), F.lit(0.5).alias("c"))
    got = {r["coverage"]: (r["n"], r["micro_f1"]) for r in AB.risk_coverage(counts, "c", [0.25, 0.5, 1.0], cells=7).collect()}
    assert got == {0.25: (250, 1.0), 0.5: (500, 1.0), 1.0: (1000, 0.5)}


def test_permutation_report_writes_rows_and_labels_once(spark, monkeypatch):
    from clinmill.sources import scratch

    df = spark.createDataFrame([(k, float(k % 2)) for k in range(200)], "row_id long, used double")
    gold = df.select("row_id", F.col("used").cast("string").alias("label"))
    calls, real = [], scratch.stored
    monkeypatch.setattr(scratch, "stored", lambda d: calls.append(d) or real(d))
    out = ML.permutation_report(df, {"a": ["used"], "b": ["used"], "c": ["used"]}, lambda d: d.select("row_id", F.col("used").cast("string").alias("label")), gold)
    assert out.count() == 4 and len(calls) == 3


def test_hybrid_equals_sql_and_exchanges_no_terms(spark, tmp_path):
    """Ids that meet (turns of 1,000 and more, repeated rows), null texts and ids, texts without words; each task holds the
    references, so no row is made of a term of a query."""
    from clinmill.plans import ORACLE_SQL, QUERIES

    r = np.random.default_rng(3)
    text = lambda: " ".join(r.choice(["thing", "nd", "ear", "Éa", "reti", "wh.", "7", "leon"], r.integers(1, 12)))
    turns = [(c, t, "user", text()) for c in range(40) for t in (0, 1, 1000, 1001, 2000)] + [(3, 1, "user", text()), (5, 0, "user", None), (None, 0, "user", "thing"), (9, 7, "user", "7 7"), (10, 7, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, text()) for i in range(30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, r.normal(0, 1, 4).tolist(), 0) for i in range(5, 44)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "fe15_hybrid_topk"
    got = QUERIES[name](spark, str(tmp_path)).select("qid", "rid", "rank", "score")
    key = lambda x: (x[0] is None, x[0], x[2], x[1], x[3])
    want = con.execute(ORACLE_SQL[name]).fetchall()
    some = lambda rows: sorted((tuple(x) for x in rows if x[0] is not None), key=key)
    assert some(got.collect()) == some(want)
    assert len(got.where("qid is null").collect()) == 5
    name = "fe16_fe17_final_codes"
    final = lambda rows: sorted(((*x[:2], -1 if x[2] is None else x[2]) for x in rows if x[0] is not None))
    assert final(QUERIES[name](spark, str(tmp_path)).select("qid", "tier", "final").collect()) == final(con.execute(ORACLE_SQL[name]).fetchall())

    q = spark.createDataFrame([(i, text(), [1.0, float(i)]) for i in range(50)], "qid long, text string, vec array<double>")
    t = spark.createDataFrame([(i, text(), [float(i), 1.0]) for i in range(20)], "rid long, text string, vec array<double>")
    words = F.split("text", " ")
    few = A.text_topk(q, t, words, 3)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    for side in ("FEW", "HELD"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(R, side, 5)
            assert sorted(map(tuple, few.collect())) == sorted(map(tuple, A.text_topk(q, t, words, 3).collect()))
