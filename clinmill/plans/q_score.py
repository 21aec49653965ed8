"""Queries over scoring, calibration, abstention, baselines and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import abstain as AB
from ..operators import baselines as BL
from ..operators import calibrate as CA
from ..operators import drift as DR
from ..operators import metrics as EV
from .base import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

PAIRS = """g AS (SELECT DISTINCT row_id, label FROM gold), h AS (SELECT DISTINCT row_id, label FROM pred WHERE p >= 0.5),
pr AS (SELECT coalesce(g.row_id, h.row_id) AS row_id, coalesce(g.label, h.label) AS label, (g.row_id IS NOT NULL)::INT AS y, (h.row_id IS NOT NULL)::INT AS z FROM g FULL JOIN h ON g.row_id = h.row_id AND g.label = h.label),
rc AS (SELECT pid AS row_id, coalesce(sum(y * z), 0) AS tp, coalesce(sum(z), 0) AS n_pred, coalesce(sum(y), 0) AS n_gold FROM enc LEFT JOIN pr ON pr.row_id = pid GROUP BY pid),
lc AS (SELECT label, sum(y * z) AS tp, sum(z) AS n_pred, sum(y) AS n_gold, coalesce(2.0::DOUBLE * sum(y * z) / nullif(sum(y) + sum(z), 0), 0) AS f1 FROM pr GROUP BY label)"""
NAMES = ("gold", "pred", "enc")


def _rows(enc):
    return enc.select(F.col("pid").alias("row_id"))


def _known(enc, *cols):
    """Columns of encounters for their rows. They are as many as the rows, so they are merged: by the bytes of well-packed files
    Spark would take them for a small table and copy them whole to each task."""
    return enc.select(F.col("pid").alias("row_id"), *cols).hint("merge")


def _hit(pred):
    return pred.where("p >= 0.5")


@query(
    "ev01_set_metrics",
    f"WITH {PAIRS} SELECT round(sum(tp)::DOUBLE / sum(n_pred), 6) AS micro_precision, round(sum(tp)::DOUBLE / sum(n_gold), 6) AS micro_recall, round(2.0 * sum(tp) / (sum(n_pred) + sum(n_gold)), 6) AS micro_f1, round(avg(CASE WHEN n_pred + n_gold = tp THEN CASE WHEN tp = 0 THEN 1.0 ELSE tp::DOUBLE / (n_pred + n_gold - tp) END ELSE tp::DOUBLE / (n_pred + n_gold - tp) END), 6) AS jaccard, round(avg((n_pred + n_gold - tp = tp)::INT), 6) AS exact_match, round(avg(n_pred), 6) AS mean_pred_size, round(avg(n_gold), 6) AS mean_gold_size, round(avg((n_pred = 0)::INT), 6) AS empty_pred_rate FROM rc",
    *NAMES,
)
def _(gold, pred, enc):
    m = EV.set_metrics(_rows(enc), gold, _hit(pred))
    return R6(m, *m.columns)


@query("ev02_macro_f1", f"WITH {PAIRS}, t AS (SELECT label FROM (SELECT label, row_number() OVER (ORDER BY count(*), label) AS r, count(*) OVER () AS k FROM g GROUP BY label) WHERE r <= greatest(k // 2, 1)) SELECT round(avg(f1) FILTER (n_gold > 0), 6) AS macro_present, round(avg(f1), 6) AS macro_all, round(avg(f1) FILTER (n_gold + n_pred > 0), 6) AS macro_seen, round(avg(f1) FILTER (label IN (SELECT label FROM t)), 6) AS macro_tail FROM lc", *NAMES)
def _(gold, pred, enc):
    m = EV.macro_f1(gold, _hit(pred), gold.select("label").unionByName(pred.select("label")), EV.tail_labels(gold))
    return R6(m, *m.columns)


@query("ev03_by_stratum", f"WITH {PAIRS}, s AS (SELECT *, CASE WHEN n_gold >= 4600 THEN 'head' ELSE 'tail' END AS stratum FROM lc) SELECT stratum, count(*) AS n_labels, round(2.0 * sum(tp) / (sum(n_pred) + sum(n_gold)), 6) AS micro_f1, round(avg(f1), 6) AS macro_f1 FROM s GROUP BY stratum", *NAMES)
def _(gold, pred, enc):
    st = gold.distinct().groupBy("label").agg(F.count("*").alias("n")).select("label", F.when(F.col("n") >= 4600, "head").otherwise("tail").alias("stratum"))
    return R6(EV.by_stratum(gold, _hit(pred), st), "micro_f1", "macro_f1")


@query("ev04_at_k", "WITH b AS (SELECT row_id, label, max(p) AS p FROM pred GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) AS r FROM b), g AS (SELECT DISTINCT row_id, label, 1 AS y FROM gold), n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id), k AS (SELECT unnest([1, 3, 5]) AS k), h AS (SELECT k, r.row_id, coalesce(sum(y) FILTER (r <= k), 0) AS h FROM r LEFT JOIN g ON g.row_id = r.row_id AND g.label = r.label, k GROUP BY 1, 2) SELECT k, round(avg(h::DOUBLE / k), 6) AS precision, round(avg(h::DOUBLE / n), 6) AS recall FROM h LEFT JOIN n USING (row_id) GROUP BY k", "gold", "pred")
def _(gold, pred):
    return R6(EV.at_k(gold, pred, [1, 3, 5]), "precision", "recall")


@query("ev05_empty_rx", f"WITH {PAIRS}, c AS (SELECT count_if(n_pred = 0 AND n_gold = 0) AS tp, count_if(n_pred = 0) AS np, count_if(n_gold = 0) AS ng, count(*) AS n FROM rc) SELECT round(coalesce(tp::DOUBLE / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(ng, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(np + ng, 0), 0), 6) AS f1, round(np::DOUBLE / n, 6) AS pred_rate, round(ng::DOUBLE / n, 6) AS gold_rate FROM c", *NAMES)
def _(gold, pred, enc):
    m = EV.empty_rx(EV.row_counts(gold, _hit(pred), _rows(enc)))
    return R6(m, *m.columns)


@query("ev06_micro_at", "WITH t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS thr) SELECT thr, round(coalesce(2.0 * count_if(p >= thr AND y = 1) / (count_if(p >= thr) + sum(y)), 0), 6) AS micro_f1 FROM bin, t GROUP BY thr", "bin")
def _(b):
    c = CA.threshold_curve(b, [], [0.3, 0.5, 0.7])
    return c.select("thr", F.round(C.prf("tp", "n_pred", "n_gold")["f1"], 6).alias("micro_f1"))


@query("ev07_ece", "WITH l AS (SELECT grp, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM bin GROUP BY 1, 2) SELECT grp, round(sum(abs(sy - sp)) / sum(n), 6) AS ece FROM l GROUP BY grp", "bin")
def _(b):
    return R6(EV.ece(b, ["grp"]), "ece")


@query("ev07_ece_right", "WITH l AS (SELECT CASE WHEN p > 0 THEN ceil(p * 15) END AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM bin GROUP BY 1) SELECT round(sum(CASE WHEN b IS NULL THEN 0 ELSE abs(sy - sp) END) / sum(n), 6) AS ece FROM l", "bin")
def _(b):
    return R6(EV.ece(b, [], 15, "right"), "ece")


@query("ev08_brier", "SELECT grp, round(avg((p - y) * (p - y)), 6) AS brier FROM bin GROUP BY grp", "bin")
def _(b):
    return R6(EV.brier(b, ["grp"]), "brier")


@query("ev09_auroc_ap", "WITH d AS (SELECT grp, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM bin GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY grp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY grp ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY grp ORDER BY p DESC) AS k FROM d) SELECT grp, round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS auroc, round(sum(tp / k * pos) / sum(pos), 6) AS avg_precision FROM w GROUP BY grp", "bin")
def _(b):
    return R6(EV.auroc(b, ["grp"]).join(EV.avg_precision(b, ["grp"]), "grp"), "auroc", "avg_precision")


@query("ev10_count_metrics", "SELECT round(avg(abs(l_tax * 100 - l_discount * 100)), 6) AS mae, round(sqrt(avg((l_tax * 100 - l_discount * 100) ** 2)), 6) AS rmse, round(1 - sum((l_tax * 100 - l_discount * 100) ** 2) / sum((l_discount * 100 - m) ** 2), 4) AS r2 FROM lineitem, (SELECT avg(l_discount * 100) AS m FROM lineitem)", "lineitem")
def _(li):
    m = EV.count_metrics(li.select((F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("p")), "y", "p")
    return m.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("r2", 4).alias("r2"))


@query("ev11_class_metrics", "WITH c AS (SELECT form AS k, count(*) AS n_gold, count_if(form = CASE WHEN line % 2 = 0 THEN form ELSE 'N' END) AS tp FROM rx GROUP BY form), h AS (SELECT CASE WHEN line % 2 = 0 THEN form ELSE 'N' END AS k, count(*) AS n_pred FROM rx GROUP BY 1), j AS (SELECT k, coalesce(n_gold, 0) AS n_gold, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred FROM c FULL JOIN h USING (k)) SELECT round(sum(tp)::DOUBLE / sum(n_gold), 6) AS accuracy, round(avg(tp::DOUBLE / n_gold) FILTER (n_gold > 0), 6) AS balanced_accuracy, round(avg(2.0 * tp / (n_gold + n_pred)), 6) AS macro_f1, round(max(n_gold)::DOUBLE / sum(n_gold), 6) AS majority FROM j", "rx")
def _(rx):
    m = EV.class_metrics(rx.select(F.col("form").alias("y"), F.when(F.col("line") % 2 == 0, F.col("form")).otherwise("N").alias("p")), "y", "p")
    return R6(m, *m.columns)


@query("ev12_attribute_accuracy", "WITH g AS (SELECT pid, drug, any_value(form) AS form, any_value(unit) AS unit FROM (SELECT pid, drug, min(form) AS form, min(unit) AS unit FROM rx GROUP BY 1, 2) GROUP BY 1, 2), p AS (SELECT pid, drug, max(form) AS form, max(unit) AS unit FROM rx WHERE line <= 3 GROUP BY 1, 2), j AS (SELECT g.form AS gf, g.unit AS gu, p.form, p.unit FROM g JOIN p USING (pid, drug)) SELECT 'form' AS attribute, count(*) AS n, round(avg((form = gf)::INT), 6) AS accuracy FROM j UNION ALL SELECT 'unit', count(*), round(avg((unit = gu)::INT), 6) FROM j", "rx")
def _(rx):
    g = rx.groupBy("pid", "drug").agg(F.min("form").alias("form"), F.min("unit").alias("unit"))
    p = rx.where("line <= 3").groupBy("pid", "drug").agg(F.max("form").alias("form"), F.max("unit").alias("unit"))
    return R6(EV.attribute_accuracy(g, p, ["pid", "drug"], ["form", "unit"]), "accuracy")


@query("ev13_to_category", "WITH m AS (SELECT label, 'k' || (substr(label, 2)::INT % 4)::VARCHAR AS cat FROM (SELECT DISTINCT label FROM gold) WHERE label <> 'c3'), g AS (SELECT DISTINCT row_id, cat FROM gold JOIN m USING (label)), h AS (SELECT DISTINCT row_id, cat FROM pred JOIN m USING (label) WHERE p >= 0.5) SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM h) AS n_pred, (SELECT count(*) FROM g JOIN h USING (row_id, cat)) AS tp", "gold", "pred")
def _(gold, pred):
    m = gold.select("label").distinct().where("label <> 'c3'").select("label", F.concat(F.lit("k"), (F.substring("label", 2, 9).cast("int") % 4).cast("string")).alias("cat"))
    to = lambda d: d.join(m, "label").select("row_id", F.col("cat").alias("label")).distinct()
    return EV.row_counts(to(gold), to(_hit(pred))).agg(F.sum("n_gold").alias("n_gold"), F.sum("n_pred").alias("n_pred"), F.sum("tp").alias("tp"))


N_BOOT = 1000


def rep_sql(kinds: str, seed: int, name: str = "rep", by: str = "system, ") -> str:
    """CTEs of the replicates over (k, m, cs): kinds of row, their rows, and the counts of each system."""
    h = lambda part: f"(('0x' || substr(h, 1 + 8 * ({part}), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    z = f"sqrt(-2 * ln({h('2 * (b % 4 // 2)')})) * CASE b % 2 WHEN 0 THEN cos(2 * pi() * {h('2 * (b % 4 // 2) + 1')}) ELSE sin(2 * pi() * {h('2 * (b % 4 // 2) + 1')}) END"
    return f"""{name}_h AS (SELECT b, k, cs, m, md5('{seed}:' || (b // 4) || ':' || k) AS h FROM {kinds}, (SELECT unnest(range({N_BOOT})) AS b)),
{name}_c AS (SELECT m, i, sum(exp(i * ln(m) - m - lgamma(i + 1))) OVER (PARTITION BY m ORDER BY i) AS cdf FROM (SELECT m, unnest(range(0, (m + 12 * sqrt(m) + 30)::BIGINT + 1)) AS i FROM (SELECT DISTINCT m FROM {kinds} WHERE m <= 256))),
{name}_u AS (SELECT *, {h("b % 4")} AS u, {z} AS z FROM {name}_h),
{name}_w AS (SELECT b, cs, coalesce(i + 1, 0)::DOUBLE AS w FROM (SELECT * FROM {name}_u WHERE m <= 256) x ASOF LEFT JOIN {name}_c y ON x.m = y.m AND x.u >= y.cdf
  UNION ALL SELECT b, cs, greatest(round_even(m + sqrt(m) * z + (z * z - 1) / 6, 0), 0) AS w FROM {name}_u WHERE m > 256),
{name} AS (SELECT {by}b, coalesce(2.0::DOUBLE * sum(w * tp) / nullif(sum(w * n_pred) + sum(w * n_gold), 0), 0) AS micro_f1 FROM (SELECT b, w, unnest(cs, recursive := true) FROM {name}_w) GROUP BY ALL)"""


BOOT = f"""s AS (SELECT DISTINCT row_id, label, 'a' AS system FROM pred WHERE p >= 0.4 UNION ALL SELECT DISTINCT row_id, label, 'b' FROM pred WHERE p >= 0.6),
g AS (SELECT DISTINCT row_id, label FROM gold), gn AS (SELECT row_id, count(*) AS n_gold FROM g GROUP BY row_id),
sc AS (SELECT system, row_id, count(*) AS n_pred, count(g.label) AS tp FROM s LEFT JOIN g USING (row_id, label) GROUP BY 1, 2),
c AS (SELECT y.system, pid AS row_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_gold, 0) AS n_gold FROM enc CROSS JOIN (SELECT unnest(['a', 'b']) AS system) y LEFT JOIN sc ON sc.row_id = pid AND sc.system = y.system LEFT JOIN gn ON gn.row_id = pid),
kd AS (SELECT k, count(*)::DOUBLE AS m, any_value(cs) AS cs FROM (SELECT row_id, string_agg(system || ':' || tp || ':' || n_pred || ':' || n_gold, ';' ORDER BY system) AS k, list({{'system': system, 'tp': tp, 'n_pred': n_pred, 'n_gold': n_gold}}) AS cs FROM c GROUP BY row_id) GROUP BY k),
{rep_sql("kd", 9)}"""


def _boot(gold, pred, enc):
    parts = [EV.row_counts(gold, pred.where(F.col("p") >= t), _rows(enc)).withColumn("system", F.lit(s)) for s, t in (("a", 0.4), ("b", 0.6))]
    return EV.bootstrap(parts[0].unionByName(parts[1]), ["system"], N_BOOT, 9)


@query("ev14_bootstrap", f"WITH {BOOT} SELECT system, b::INT AS b, round(micro_f1, 6) AS micro_f1 FROM rep", *NAMES)
def _(gold, pred, enc):
    return R6(_boot(gold, pred, enc), "micro_f1")


@query("ev15_delta_stats", f"WITH {BOOT}, d AS (SELECT x.micro_f1 - y.micro_f1 AS d FROM rep x JOIN rep y USING (b) WHERE x.system = 'a' AND y.system = 'b') SELECT round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo95, round(quantile_cont(d, 0.975), 6) AS hi95, round(avg((d > 0)::INT), 6) AS p_better FROM d", *NAMES)
def _(gold, pred, enc):
    r = _boot(gold, pred, enc)
    m = EV.delta_stats(r.where("system = 'a'"), r.where("system = 'b'"), "micro_f1")
    return R6(m, *m.columns)


@query("ev18_benchmark_table", f"WITH {BOOT} SELECT c.system, e.split AS protocol, count(*) AS n, round(coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(n_pred) + sum(n_gold), 0), 0), 6) AS micro_f1 FROM c JOIN enc e ON e.pid = c.row_id GROUP BY 1, 2", *NAMES)
def _(gold, pred, enc):
    parts = [EV.row_counts(gold, pred.where(F.col("p") >= t), _rows(enc)).withColumn("system", F.lit(s)) for s, t in (("a", 0.4), ("b", 0.6))]
    j = parts[0].unionByName(parts[1]).join(_known(enc, F.col("split").alias("protocol")), "row_id")
    s = j.groupBy("system", "protocol").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")))
    return s.select("system", "protocol", "n", F.round(C.prf("tp", "n_pred", "n_gold")["f1"], 6).alias("micro_f1"))


@query("ev22_by_group", f"WITH {PAIRS} SELECT kind, count(*) AS n, round(coalesce(2.0 * sum(tp) / nullif(sum(n_pred) + sum(n_gold), 0), 0), 6) AS micro_f1 FROM rc JOIN enc ON pid = row_id GROUP BY kind", *NAMES)
def _(gold, pred, enc):
    j = EV.row_counts(gold, _hit(pred), _rows(enc)).join(_known(enc, "kind"), "row_id")
    s = j.groupBy("kind").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("tp", "n_pred", "n_gold")))
    return s.select("kind", "n", F.round(C.prf("tp", "n_pred", "n_gold")["f1"], 6).alias("micro_f1"))


@query("ev21_ev26_variants", "SELECT kind, round(avg(price) FILTER (status = 'F'), 4) AS f, round(avg(price) FILTER (status = 'O'), 4) AS o, round(avg(price) FILTER (status = 'F') - avg(price) FILTER (status = 'O'), 4) AS delta FROM enc GROUP BY kind", "enc")
def _(enc):
    p = enc.groupBy("kind").pivot("status", ["F", "O"]).agg(F.avg("price"))
    return p.select("kind", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"), F.round(F.col("F") - F.col("O"), 4).alias("delta"))


@query("ev25_calibration_table", "WITH l AS (SELECT grp, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM bin GROUP BY 1, 2), e AS (SELECT grp, sum(abs(sy - sp)) / sum(n) AS ece FROM l GROUP BY grp) SELECT grp, round(ece, 6) AS ece, round(avg((p - y) * (p - y)), 6) AS brier FROM bin JOIN e USING (grp) GROUP BY grp, ece", "bin")
def _(b):
    return R6(EV.ece(b, ["grp"]).join(EV.brier(b, ["grp"]), "grp"), "ece", "brier")


# ---- calibration and operating points

GRID_SQL = "(SELECT unnest([" + ", ".join(map(str, CA.GRID)) + "])::DOUBLE AS thr) t"


@query("ca03_tune_threshold", f"WITH c AS (SELECT grp, thr, round(coalesce(2.0::DOUBLE * count_if(p >= thr AND y = 1) / nullif(count_if(p >= thr) + sum(y), 0), 0), 9) AS f FROM bin, {GRID_SQL} GROUP BY 1, 2) SELECT grp, thr, round(f, 6) AS micro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f DESC, thr) AS r FROM c) WHERE r = 1", "bin")
def _(b):
    return R6(CA.tune_threshold(b, ["grp"]), "micro_f1")


@query("ca04_size_matched", f"WITH c AS (SELECT thr, round(abs(count_if(p >= thr)::DOUBLE / count(DISTINCT row_id) - 0.4), 9) AS gap FROM bin, {GRID_SQL} GROUP BY thr) SELECT thr FROM c ORDER BY gap, thr LIMIT 1", "bin")
def _(b):
    return CA.size_matched_threshold(b, 0.4, b.count())


@query("ca05_threshold_by_group", f"WITH b2 AS (SELECT *, CASE WHEN row_id % 500 = 0 THEN 99 ELSE grp END AS gg FROM bin WHERE NOT (row_id % 500 = 0 AND row_id > 5000)), c AS (SELECT gg, thr, round(coalesce(2.0::DOUBLE * count_if(p >= thr AND y = 1) / nullif(count_if(p >= thr) + sum(y), 0), 0), 9) AS f FROM b2, {GRID_SQL} GROUP BY 1, 2), o AS (SELECT thr, round(coalesce(2.0::DOUBLE * count_if(p >= thr AND y = 1) / nullif(count_if(p >= thr) + sum(y), 0), 0), 9) AS f FROM b2, {GRID_SQL} GROUP BY 1), w AS (SELECT gg, thr FROM (SELECT *, row_number() OVER (PARTITION BY gg ORDER BY f DESC, thr) AS r FROM c) WHERE r = 1), n AS (SELECT gg, count(DISTINCT row_id) AS n FROM b2 GROUP BY gg) SELECT gg, CASE WHEN n >= 30 THEN w.thr ELSE (SELECT thr FROM o ORDER BY f DESC, thr LIMIT 1) END AS thr FROM w JOIN n USING (gg)", "bin")
def _(b):
    d = b.withColumn("gg", F.when(F.col("row_id") % 500 == 0, 99).otherwise(F.col("grp"))).where("not (row_id % 500 = 0 and row_id > 5000)")
    return CA.threshold_by_group(d, "gg")


@query("ca06_span_max", "SELECT row_id, label, max(p) AS p FROM pred GROUP BY 1, 2", "pred")
def _(pred):
    return CA.span_max(pred)


@query("ca01_isotonic", None, "bin")
def _(b):
    return CA.calibrate(b.where("grp < 4"), b.where("grp >= 4"), "isotonic").select("row_id", "p", "p_cal")


@query("ca02_select_calibrator", None, "bin")
def _(b):
    return CA.select_calibrator(b.select("p", "y", F.xxhash64("row_id").alias("h")), F.abs(F.col("h")), 3)


# ---- abstention

CONF = """cf AS (SELECT row_id, max(p) AS max_prob, count_if(p >= 0.5)::DOUBLE AS n_above_thr, sum(p * ln(p + 1e-9) + (1 - p) * ln(1 - p + 1e-9)) AS neg_entropy, 2 * sum(CASE WHEN p >= 0.5 THEN p ELSE 0 END) / greatest(count_if(p >= 0.5) + sum(p), 1e-9) AS expected_f1,
  list_sort(list(p), 'DESC')[2] AS second FROM pred GROUP BY row_id)"""


@query("ab01_ab02_confidence", f"WITH {CONF} SELECT row_id, max_prob, round(max_prob - coalesce(second, 0), 6) AS margin, n_above_thr, round(neg_entropy, 5) AS neg_entropy, round(expected_f1, 6) AS expected_f1 FROM cf", "pred")
def _(pred):
    c = AB.confidence(pred, 0.5)
    return c.select("row_id", "max_prob", F.round("margin", 6).alias("margin"), "n_above_thr", F.round("neg_entropy", 5).alias("neg_entropy"), F.round("expected_f1", 6).alias("expected_f1"))


RISK = f"{PAIRS}, {CONF}, ranked AS (SELECT row_number() OVER (ORDER BY round(coalesce(expected_f1, 0), 6) DESC, rc.row_id) AS k, sum(tp) OVER w AS tp, sum(n_pred) OVER w AS n_pred, sum(n_gold) OVER w AS n_gold FROM rc LEFT JOIN cf ON cf.row_id = rc.row_id WINDOW w AS (ORDER BY round(coalesce(expected_f1, 0), 6) DESC, rc.row_id ROWS UNBOUNDED PRECEDING)), curve AS (SELECT cov, n, round(coalesce(2.0::DOUBLE * tp / nullif(n_pred + n_gold, 0), 0), 6) AS micro_f1 FROM (SELECT cov, greatest(round_even(cov * (SELECT count(*) FROM rc), 0), 1)::BIGINT AS n FROM (SELECT unnest([{', '.join(map(str, AB.GRID))}])::DOUBLE AS cov)) JOIN ranked ON k = n)"


def _counts(gold, pred, enc):
    c = EV.row_counts(gold, _hit(pred), _rows(enc))
    of = gold.select("row_id").unionAll(pred.select("row_id")).unionAll(_rows(enc))
    return c.join(AB.confidence(pred, 0.5, of).hint("merge"), "row_id", "left").fillna(0.0, ["expected_f1", "max_prob"])


@query("ab03_risk_coverage", f"WITH {RISK} SELECT cov AS coverage, n, micro_f1 FROM curve", *NAMES)
def _(gold, pred, enc):
    return R6(AB.risk_coverage(_counts(gold, pred, enc), "expected_f1"), "micro_f1")


def _curve_sql(signal: str) -> str:
    return RISK.split("ranked AS")[1].replace("round(coalesce(expected_f1, 0), 6)", signal).replace("ranked", "{n}_r").replace("curve AS", "{n}_c AS")


_SIGNALS = {"expected_f1": "round(coalesce(expected_f1, 0), 6)", "max_prob": "round(coalesce(max_prob, 0), 6)", "random": "('0x' || substr(md5(concat_ws(':', '1', rc.row_id::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"}


@query("ab04_select_signal", f"WITH {PAIRS}, {CONF}, " + ", ".join(f"{n}_r AS" + _curve_sql(e).replace("{n}", n) for n, e in _SIGNALS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS signal, round(avg(micro_f1), 5) AS auc FROM {n}_c" for n in _SIGNALS), *NAMES)
def _(gold, pred, enc):
    s = AB.select_signal(_counts(gold, pred, enc), ["expected_f1", "max_prob"], C.hash_rank(1, "row_id") / float(1 << 32))
    return s.withColumn("auc", F.round("auc", 5))


@query("ab05_cutpoints", f"WITH {CONF}, q AS (SELECT cov, quantile_cont(expected_f1, round(1 - cov, 2)) AS cutpoint FROM cf, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS cov) GROUP BY cov) SELECT cov AS coverage, round(cutpoint, 6) AS cutpoint, round(avg((expected_f1 >= cutpoint)::INT), 3) AS achieved FROM cf, q GROUP BY 1, 2".replace("quantile_cont(expected_f1, round(1 - cov, 2))", "CASE cov WHEN 0.2 THEN quantile_cont(expected_f1, 0.8) WHEN 0.4 THEN quantile_cont(expected_f1, 0.6) WHEN 0.6 THEN quantile_cont(expected_f1, 0.4) ELSE quantile_cont(expected_f1, 0.2) END"), "pred")
def _(pred):
    c = AB.cutpoints(AB.confidence(pred, 0.5), "expected_f1", [0.2, 0.4, 0.6, 0.8])
    return c.select("coverage", F.round("cutpoint", 6).alias("cutpoint"), F.round("achieved", 3).alias("achieved"))


POLICY = "pol AS (SELECT * FROM (VALUES ('drug', 0.45, 0.5, true), ('advice', 0.2, 0.5, true), ('test', 0.9, 0.4, false)) v(component, cutpoint, threshold, usable))"


def _policy(df):
    return df.sparkSession.createDataFrame([("drug", 0.45, 0.5, True), ("advice", 0.2, 0.5, True), ("test", 0.9, 0.4, False)], "component string, cutpoint double, threshold double, usable boolean")


_comp = "CASE CAST(row_id % 4 AS INT) WHEN 0 THEN 'drug' WHEN 1 THEN 'advice' WHEN 2 THEN 'test' ELSE 'form' END"


def _scored(b):
    return b.select("row_id", F.expr(_comp).alias("component"), F.col("p").alias("confidence"), (F.col("grp") < 2).alias("sparse"))


@query("ab06_usable", "SELECT row_id, NOT (p <= p2 + 1e-4) AND NOT (p <= 1e-9) AS usable, CASE WHEN p <= p2 + 1e-4 THEN 'signal does not beat the random control' WHEN p <= 1e-9 THEN 'cut-point lies on the confidence floor' ELSE '' END AS reason FROM bin", "bin")
def _(b):
    return b.select("row_id", *(v.alias(k) for k, v in AB.usable(F.col("p"), F.col("p2"), F.col("p")).items()))


@query("ab07_decide", f"WITH {POLICY}, s AS (SELECT row_id, {_comp} AS component, p, grp < 2 AS sparse FROM bin) SELECT row_id, component, CASE WHEN NOT coalesce(usable, false) OR NOT sparse THEN true ELSE p >= cutpoint END AS cover FROM s LEFT JOIN pol USING (component)", "bin")
def _(b):
    return AB.decide(_scored(b), _policy(b), "sparse").select("row_id", "component", "cover")


@query("ab08_stale_guard", f"WITH {POLICY}, srv AS (SELECT {_comp} AS component, CASE WHEN row_id % 4 = 1 THEN 0.45 ELSE 0.5 END::DOUBLE AS threshold FROM bin GROUP BY 1, 2) SELECT component, cutpoint::DOUBLE AS cutpoint, pol.threshold::DOUBLE AS threshold, usable AND coalesce(abs(pol.threshold - srv.threshold) <= 1e-9, false) AS usable FROM pol LEFT JOIN srv USING (component)", "bin")
def _(b):
    served = b.select(F.expr(_comp).alias("component"), F.when(F.col("row_id") % 4 == 1, 0.45).otherwise(0.5).alias("threshold")).distinct()
    return AB.check_threshold(_policy(b), served)


@query("ab09_policy_report", f"WITH {PAIRS}, {CONF}, x AS (SELECT rc.*, kind, coalesce(expected_f1, 0) >= 0.4 AS cover FROM rc JOIN enc ON pid = rc.row_id LEFT JOIN cf ON cf.row_id = rc.row_id) SELECT kind, count(*) AS n, round(avg(cover::INT), 6) AS coverage, round(coalesce(2.0::DOUBLE * sum(tp) FILTER (cover) / nullif(sum(n_pred + n_gold) FILTER (cover), 0), 0), 6) AS micro_f1 FROM x GROUP BY kind", *NAMES)
def _(gold, pred, enc):
    c = _counts(gold, pred, enc).join(_known(enc, "kind"), "row_id").withColumn("cover", F.col("expected_f1") >= 0.4)
    return R6(AB.policy_report(c, ["kind"]), "coverage", "micro_f1")


@query("ab10_rank_equivalence", f"WITH {CONF}, q AS (SELECT quantile_cont(expected_f1, 0.2) AS cut FROM cf), r AS (SELECT expected_f1 >= cut AS above, cut, row_number() OVER (ORDER BY expected_f1 DESC, row_id) AS place FROM cf, q), k AS (SELECT count_if(above) AS k FROM r) SELECT count(*) AS n, any_value(k) AS n_covered, round(any_value(cut), 6) AS cutpoint, count_if(above <> (place <= k)) AS n_differ FROM r, k", "pred")
def _(pred):
    return R6(AB.rank_equivalence(AB.confidence(pred, 0.5), "expected_f1", 0.8), "cutpoint")


@query("ab11_tk04_suggestions", "SELECT row_id, string_agg(label, ',' ORDER BY r) AS labels FROM (SELECT row_id, label, row_number() OVER (PARTITION BY row_id ORDER BY p DESC, label) AS r FROM (SELECT row_id, label, max(p) AS p FROM pred GROUP BY 1, 2)) WHERE r <= 3 GROUP BY row_id", "pred")
def _(pred):
    return AB.ranked(CA.span_max(pred), 3)


@query("ab12_max_abs_diff", "SELECT round(max(abs(a.p - (b.p + (row_id % 7) / 1000.0))), 6) AS max_abs_diff FROM (SELECT row_id, label, max(p) AS p FROM pred GROUP BY 1, 2) a JOIN (SELECT row_id, label, max(p) AS p FROM pred GROUP BY 1, 2) b USING (row_id, label)", "pred")
def _(pred):
    a = CA.span_max(pred)
    return R6(AB.max_abs_diff(a, a.withColumn("p", F.col("p") + (F.col("row_id") % 7) / 1000.0)), "max_abs_diff")


@query("ab13_sparse_table", f"WITH {PAIRS}, {CONF}, x AS (SELECT rc.*, length(note) < 12 AS sparse, coalesce(expected_f1, 0) < 0.4 AS abstain FROM rc JOIN enc ON pid = rc.row_id LEFT JOIN cf ON cf.row_id = rc.row_id) SELECT sparse, count(*) AS n, round(avg(abstain::INT), 6) AS abstain_rate, round(coalesce(2.0::DOUBLE * sum(tp) FILTER (NOT abstain) / nullif(sum(n_pred + n_gold) FILTER (NOT abstain), 0), 0), 6) AS micro_f1 FROM x GROUP BY sparse", *NAMES)
def _(gold, pred, enc):
    c = _counts(gold, pred, enc).join(_known(enc, (F.length("note") < 12).alias("sparse")), "row_id").withColumn("cover", F.col("expected_f1") >= 0.4)
    return AB.policy_report(c, ["sparse"]).select("sparse", "n", F.round(1 - F.col("coverage"), 6).alias("abstain_rate"), F.round("micro_f1", 6).alias("micro_f1"))


# ---- labels and baselines


@query("lb01_lb02_label_spaces", "SELECT DISTINCT pid, p_type AS label FROM rx JOIN part ON p_partkey = drug WHERE p_size > 5", "rx", "part")
def _(rx, part):
    m = part.where("p_size > 5").select(F.col("p_partkey").alias("drug"), F.col("p_type").alias("label"))
    return rx.select("pid", "drug").join(m, "drug").select("pid", "label").distinct()


@query("lb03_supported_labels", "SELECT label, count(DISTINCT pid) AS support, row_number() OVER (ORDER BY count(DISTINCT pid) DESC, label) - 1 AS idx FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'train') GROUP BY label HAVING count(DISTINCT pid) >= 30", "rx", "enc")
def _(rx, enc):
    return BL.supported_labels(rx, enc.where("split = 'train'"), "pid", "label", 30)


@query("lb04_form_labels", "SELECT pid, CASE WHEN form IN ('A', 'N') THEN form ELSE 'other' END AS form FROM (SELECT pid, form, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, form) AS r FROM rx GROUP BY pid, form) WHERE r = 1", "rx")
def _(rx):
    return BL.form_labels(rx, "pid", "form", ["A", "N"])


@query("lb06_tail_labels", "SELECT label FROM (SELECT label, row_number() OVER (ORDER BY count(DISTINCT row_id), label) AS r, count(*) OVER () AS k FROM gold GROUP BY label) WHERE r <= greatest(k // 2, 1)", "gold")
def _(gold):
    return EV.tail_labels(gold)


@query("bl01_modal_set", "WITH s AS (SELECT row_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM gold GROUP BY row_id) SELECT labels, count(*) AS n FROM s GROUP BY labels ORDER BY n DESC, labels LIMIT 1", "gold")
def _(gold):
    return BL.modal_set(gold)


@query("bl02_global_prior", "SELECT label, count(DISTINCT row_id) AS n FROM gold GROUP BY label ORDER BY n DESC, label LIMIT 6", "gold")
def _(gold):
    return BL.global_prior(gold, 6)


def _part(gold, enc, split):
    return gold.join(enc.where(F.col("split") == split).select(F.col("pid").alias("row_id")), "row_id", "left_semi")


@query("bl03_prior_topk", "WITH t AS (SELECT label, row_number() OVER (ORDER BY count(DISTINCT row_id) DESC, label) AS r FROM gold WHERE row_id IN (SELECT pid FROM enc WHERE split = 'train') GROUP BY label), g AS (SELECT DISTINCT row_id, label FROM gold WHERE row_id IN (SELECT pid FROM enc WHERE split = 'val')), n AS (SELECT count(DISTINCT row_id) AS rows, count(*) AS n_gold FROM g), h AS (SELECT r, (SELECT count(*) FROM g WHERE g.label = t.label) AS hits FROM t WHERE r <= 8) SELECT r AS k, round(2.0::DOUBLE * sum(hits) OVER (ORDER BY r) / (r * rows + n_gold), 6) AS micro_f1 FROM h, n", "gold", "enc")
def _(gold, enc):
    return R6(BL.prior_topk(_part(gold, enc, "train"), _part(gold, enc, "val"), 8), "micro_f1")


@query("bl04_tk03_group_prior", "WITH t AS (SELECT prescriber, label, count(*) AS n FROM rx WHERE prescriber % 5 > 0 GROUP BY 1, 2), o AS (SELECT prescriber, label, row_number() OVER (PARTITION BY prescriber ORDER BY n DESC, label) AS rank FROM t), g AS (SELECT label, row_number() OVER (ORDER BY sum(n) DESC, label) AS rank FROM t GROUP BY label), k AS (SELECT DISTINCT prescriber FROM rx) SELECT prescriber, label, rank FROM o WHERE rank <= 3 UNION ALL SELECT prescriber, label, rank FROM k, g WHERE rank <= 3 AND prescriber NOT IN (SELECT prescriber FROM o)", "rx")
def _(rx):
    return BL.group_prior(rx.where("prescriber % 5 > 0"), "prescriber", "label", 3, rx)


@query("bl05_subset_prior", "SELECT label, count(DISTINCT row_id) AS n FROM gold WHERE row_id IN (SELECT pid FROM enc WHERE length(note) < 12) GROUP BY label ORDER BY n DESC, label LIMIT 4", "gold", "enc")
def _(gold, enc):
    return BL.global_prior(gold.join(enc.where("length(note) < 12").select(F.col("pid").alias("row_id")), "row_id", "left_semi"), 4)


@query("bl07_scalar_floors", "SELECT quantile_cont(price, 0.5) AS median, round(avg(price), 4) AS mean, (SELECT kind FROM enc WHERE split = 'train' GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) AS majority FROM enc WHERE split = 'train'", "enc")
def _(enc):
    return BL.scalar_floors(enc.where("split = 'train'"), "price", "kind").withColumn("mean", F.round("mean", 4))


# ---- drift


def _eras(rx, enc):
    j = rx.join(enc.select("pid", "year", "uid", "site"), "pid")
    return j.where("year <= 1996"), j.where("year >= 2000 and not (drug % 11 = 0 and year = 2000)")


ERAS = "a AS (SELECT * FROM rx JOIN enc USING (pid) WHERE year <= 1996), b AS (SELECT * FROM rx JOIN enc USING (pid) WHERE year >= 2000 AND NOT (drug % 11 = 0 AND year = 2000))"


@query("dr01_jsd", f"WITH {ERAS}, ca AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM a GROUP BY label), cb AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS q FROM b GROUP BY label), j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM ca FULL JOIN cb USING (label)) SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 6) AS jsd FROM j", "rx", "enc")
def _(rx, enc):
    a, b = _eras(rx.drop("prescriber"), enc)
    n = lambda d: d.groupBy("label").agg(F.count("*").alias("n"))
    return R6(DR.jsd(n(a), n(b), "label"), "jsd")


@query("dr02_vocab_shift", f"WITH {ERAS.replace('SELECT *', 'SELECT drug')}, ca AS (SELECT drug, count(*) AS n FROM a GROUP BY drug), cb AS (SELECT drug, count(*) AS n FROM b GROUP BY drug), ta AS (SELECT drug FROM ca ORDER BY n DESC, drug LIMIT 10), tb AS (SELECT drug FROM cb ORDER BY n DESC, drug LIMIT 10) SELECT round(coalesce((SELECT sum(n) FROM cb WHERE drug NOT IN (SELECT drug FROM ca))::DOUBLE / (SELECT sum(n) FROM cb), 0), 6) AS unseen_share, round((SELECT count(*) FROM ca JOIN cb USING (drug))::DOUBLE / (SELECT count(*) FROM (SELECT drug FROM ca UNION SELECT drug FROM cb)), 6) AS jaccard, (SELECT count(*) FROM ta JOIN tb USING (drug)) AS top_shared", "rx", "enc")
def _(rx, enc):
    a, b = _eras(rx.drop("prescriber"), enc)
    return R6(DR.vocab_shift(a, b, "drug"), "unseen_share", "jaccard")


@query("dr03_entity_turnover", "WITH a AS (SELECT uid FROM enc WHERE year <= 1996), b AS (SELECT uid, count(*) AS n FROM enc WHERE year >= 2000 GROUP BY uid) SELECT count(*) AS n_entities, count_if(uid NOT IN (SELECT uid FROM a)) AS n_new, round(sum(CASE WHEN uid NOT IN (SELECT uid FROM a) THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS new_row_share FROM b", "enc")
def _(enc):
    return R6(DR.entity_turnover(enc.where("year <= 1996"), enc.where("year >= 2000"), "uid"), "new_row_share")


@query("dr04_empty_rate", "SELECT year, round(avg((pid NOT IN (SELECT pid FROM rx))::INT), 6) AS empty_rate FROM enc GROUP BY year", "enc", "rx")
def _(enc, rx):
    return R6(DR.empty_rate(enc, rx, "pid", "year"), "empty_rate")


@query("dr05_label_shift", f"WITH {ERAS.replace('SELECT *', 'SELECT pid, drug')}, t AS (SELECT DISTINCT pid, drug FROM b), x AS (SELECT pid, (drug NOT IN (SELECT drug FROM a))::INT AS u FROM t) SELECT round(avg(u), 6) AS unseen_positives, (SELECT round(avg(m), 6) FROM (SELECT max(u) AS m FROM x GROUP BY pid)) AS rows_touched, round((SELECT count(*) FROM (SELECT drug FROM a INTERSECT SELECT drug FROM b))::DOUBLE / (SELECT count(*) FROM (SELECT drug FROM a UNION SELECT drug FROM b)), 6) AS jaccard FROM x", "rx", "enc")
def _(rx, enc):
    a, b = _eras(rx.drop("prescriber"), enc)
    m = DR.label_shift(a, b, "pid", "drug")
    return R6(m, *m.columns)


