"""Queries that combine operators: growth, multi-seed intervals, leaderboards, feature families, concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import text as T
from ..operators import assemble as A
from ..operators import concepts as CO
from ..operators import features as FE
from ..operators import metrics as EV
from ..operators import profile as P
from .base import query
from .q_score import BOOT, N_BOOT, NAMES, PAIRS, _boot, _hit, _known, _rows, rep_sql
from .q_text import NORM, SPANS

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("ag29_combined_totals", "WITH t AS (SELECT count(*) FILTER (kind < '3') AS old, count(*) AS new, count(DISTINCT uid) FILTER (kind < '3') AS old_p, count(DISTINCT uid) AS new_p FROM enc) SELECT 'encounters' AS measure, old AS before, new AS after, round(100.0::DOUBLE * (new - old) / old, 6) AS growth FROM t UNION ALL SELECT 'patients', old_p, new_p, round(100.0::DOUBLE * (new_p - old_p) / old_p, 6) FROM t", "enc")
def _(enc):
    old = F.col("kind") < "3"
    t = enc.agg(F.count_if(old).alias("e0"), F.count("*").alias("e1"), F.countDistinct(F.when(old, F.col("uid"))).alias("p0"), F.countDistinct("uid").alias("p1"))
    rows = t.select(F.explode(F.array(F.struct(F.lit("encounters").alias("measure"), F.col("e0").alias("before"), F.col("e1").alias("after")), F.struct(F.lit("patients").alias("measure"), F.col("p0").alias("before"), F.col("p1").alias("after")))).alias("x")).select("x.*")
    return rows.withColumn("growth", F.round(100.0 * (F.col("after") - F.col("before")) / F.col("before"), 6))


@query("ev16_seed_bootstrap", f"WITH {BOOT}, m AS (SELECT b, avg(micro_f1) AS m FROM rep GROUP BY b) SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lo95, round(quantile_cont(m, 0.975), 6) AS hi95 FROM m", *NAMES)
def _(gold, pred, enc):
    """The mean over seeds (here: systems) inside each replicate, as an interval."""
    r = _boot(gold, pred, enc).groupBy("b").agg(F.avg("micro_f1").alias("m"))
    return r.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo95"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi95"))


def _split_kinds(split: str) -> str:
    return f"k{split} AS (SELECT k, count(*)::DOUBLE AS m, any_value(cs) AS cs FROM (SELECT concat_ws(':', tp::BIGINT, n_pred::BIGINT, n_gold::BIGINT) AS k, [{{'tp': tp::BIGINT, 'n_pred': n_pred::BIGINT, 'n_gold': n_gold::BIGINT}}] AS cs FROM rc JOIN enc ON pid = row_id WHERE split = '{split}') GROUP BY k)"


@query("ev17_cross_split_delta", f"WITH {PAIRS}, {_split_kinds('test')}, {_split_kinds('train')}, {rep_sql('ktest', 1, 'x', '')}, {rep_sql('ktrain', 2, 'y', '')}, d AS (SELECT x.micro_f1 - y.micro_f1 AS d, (x.micro_f1 - y.micro_f1) / y.micro_f1 AS r FROM x JOIN y USING (b)) SELECT round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo95, round(quantile_cont(d, 0.975), 6) AS hi95, round(avg((d > 0)::INT), 6) AS p_better, round(avg(r), 6) AS relative FROM d", *NAMES)
def _(gold, pred, enc):
    """Difference of two splits' scores over independent replicates, absolute and relative."""
    part = lambda s, seed: EV.bootstrap(EV.row_counts(gold, _hit(pred), _rows(enc.where(F.col("split") == s))), [], N_BOOT, seed)
    d = EV.delta_stats(part("test", 1), part("train", 2), "micro_f1", relative=True)
    return R6(d, *d.columns)


@query("ca07_leaderboard", f"WITH {PAIRS}, r AS (SELECT kind, count(*) AS n, 2.0::DOUBLE * sum(tp) / nullif(sum(n_pred) + sum(n_gold), 0) AS f FROM rc JOIN enc ON pid = row_id WHERE length(note) < 12 GROUP BY kind) SELECT kind, n, round(f, 6) AS micro_f1, row_number() OVER (ORDER BY round(f, 6) DESC, kind) AS place FROM r", *NAMES)
def _(gold, pred, enc):
    from pyspark.sql import Window

    few = enc.where("length(note) < 12")
    c = EV.row_counts(gold, _hit(pred), _rows(few)).join(_known(few, "kind"), "row_id")
    s = c.groupBy("kind").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in ("tp", "n_pred", "n_gold"))).select("kind", "n", F.round(C.prf("tp", "n_pred", "n_gold")["f1"], 6).alias("micro_f1"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("micro_f1"), "kind")))  # over systems


@query("ev24_report_tables", f"WITH {PAIRS} SELECT split, year, count(*) AS n, round(coalesce(2.0::DOUBLE * sum(tp) / nullif(sum(n_pred) + sum(n_gold), 0), 0), 6) AS micro_f1, round(avg((n_gold = 0)::INT), 6) AS empty_gold FROM rc JOIN enc ON pid = row_id GROUP BY split, year", *NAMES)
def _(gold, pred, enc):
    c = EV.row_counts(gold, _hit(pred), _rows(enc)).join(_known(enc, "split", "year"), "row_id")
    s = c.groupBy("split", "year").agg(F.count("*").alias("n"), F.avg((F.col("n_gold") == 0).cast("double")).alias("e"), *(F.sum(x).alias(x) for x in ("tp", "n_pred", "n_gold")))
    return s.select("split", "year", "n", F.round(C.prf("tp", "n_pred", "n_gold")["f1"], 6).alias("micro_f1"), F.round("e", 6).alias("empty_gold"))


FAMILIES = {"age": "demog", "sex": "demog", "price": "vitals", "note": "text", "visit": "temporal", "site": "site", "prescriber": "prescriber"}


@query("fe07_fe08_families", "SELECT family, count(*) AS n FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in FAMILIES.items()) + ") v(col, family) WHERE col IN (SELECT column_name FROM (DESCRIBE enc)) GROUP BY family", "enc")
def _(enc):
    t = FE.family_table(enc.sparkSession, {k: v for k, v in FAMILIES.items() if k in enc.columns})
    return t.groupBy("family").agg(F.count("*").alias("n"))


CONCEPTS = """RECURSIVE p AS (SELECT vec_id, vec_id::VARCHAR AS phrase, (label + 1)::BIGINT AS freq, embedding::DOUBLE[] AS vec FROM embeddings), top AS (SELECT * FROM p ORDER BY freq DESC, phrase LIMIT 4000),
e AS (SELECT a.phrase AS a, b.phrase AS b FROM top a, top b WHERE a.phrase <> b.phrase AND round(list_cosine_similarity(a.vec, b.vec), 9) >= 0.36),
r AS (SELECT phrase AS id, phrase AS root FROM top UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), g AS (SELECT top.*, root FROM top JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) ON id = phrase),
k AS (SELECT *, row_number() OVER (ORDER BY support DESC, label) - 1 AS concept FROM (SELECT root, sum(freq) AS support, list(phrase ORDER BY freq DESC, phrase DESC)[1] AS label FROM g GROUP BY root) WHERE support >= 25),
own AS (SELECT vec_id, vec, concept FROM g JOIN k USING (root)), el AS (SELECT concept, freq, unnest(g.vec) AS v, generate_subscripts(g.vec, 1) AS i FROM g JOIN k USING (root)),
ce AS (SELECT concept, list(v ORDER BY i) AS c FROM (SELECT concept, i, sum(v * freq) / sum(freq) AS v FROM el GROUP BY 1, 2) GROUP BY 1),
nr AS (SELECT vec_id, concept, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(vec, c), 9) DESC, concept) AS n, round(list_cosine_similarity(vec, c), 9) AS s FROM p, ce WHERE vec_id NOT IN (SELECT vec_id FROM own))"""


@query("fe12_fe13_concepts", f"WITH {CONCEPTS} SELECT vec_id AS key, concept, 'exact' AS how FROM own UNION ALL SELECT vec_id, concept, 'centroid' FROM nr WHERE n = 1 AND s >= 0.36", "embeddings")
def _(em):
    """Concepts over the vectors, the label standing in for how often a phrase occurs."""
    p = em.select(F.col("vec_id").cast("string").alias("phrase"), (F.col("label") + 1).cast("long").alias("freq"), F.col("embedding").alias("vec"))
    c = CO.induce_concepts(p, tau=0.36)  # the vectors of the table lie far apart
    spans = em.select(F.col("vec_id").alias("key"), F.col("vec_id").cast("string").alias("phrase"), F.col("embedding").alias("vec"))
    return CO.assign_concepts(spans, c, 0.36)


_plain = SPANS.replace("SELECT DISTINCT note FROM enc", f"SELECT DISTINCT {NORM} AS note FROM enc")


@query("fe14_text_features", f"WITH {_plain}, n AS (SELECT pid, {NORM} AS note FROM enc) SELECT pid, note AS normalized_text, spans AS complaint_spans, len(s)::INT AS n_spans, (note IN ('general check up', 'NO', 'Nil', 'no specific complaints.'))::INT AS no_complaint FROM n JOIN sl USING (note)", "enc")
def _(enc):
    s = enc.select("pid", T.norm_text("note").alias("normalized_text"), T.segment(T.norm_text("note")).alias("s"), T.is_no_complaint("note").cast("int").alias("no_complaint"))
    return s.select("pid", "normalized_text", F.array_join("s", "|").alias("complaint_spans"), F.size("s").alias("n_spans"), "no_complaint")


@query("fe05_ncd_join", "WITH n AS (SELECT uid, min(pid) AS first FROM enc GROUP BY uid) SELECT pid, first AS ncd_first FROM enc LEFT JOIN n ON n.uid = enc.uid", "enc")
def _(enc):
    n = enc.groupBy("uid").agg(F.min("pid").alias("ncd_first"))
    return A.join_first(enc.select("pid", "uid"), n, "uid", "ncd_first").select("pid", "ncd_first")


@query("tk11_examples", "SELECT pid, drug, qty FROM rx WHERE qty > 49 ORDER BY qty DESC, pid, drug, line LIMIT 15", "rx")
def _(rx):
    return P.examples(rx.where("qty > 49"), 15, F.desc("qty"), "pid", "drug", "line").select("pid", "drug", "qty")


@query("wn09_first_per_key", "SELECT label, drug FROM (SELECT label, drug, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, drug) AS r FROM rx GROUP BY label, drug) WHERE r = 1", "rx")
def _(rx):
    n = rx.groupBy("label", "drug").agg(F.count("*").alias("n"))
    return A.join_first(rx.select("label").distinct(), n, "label", F.desc("n"), "drug").select("label", "drug")


@query("so03_jaccard", "WITH a AS (SELECT pid, list(DISTINCT label) AS s FROM rx GROUP BY pid) SELECT pid, round(len(list_intersect(s, ['c1', 'c2', 'c3']))::DOUBLE / len(list_distinct(list_concat(s, ['c1', 'c2', 'c3']))), 6) AS jaccard FROM a", "rx")
def _(rx):
    three = F.array(*(F.lit(x) for x in ("c1", "c2", "c3")))
    a = rx.groupBy("pid").agg(F.collect_set("label").alias("s"))
    return a.select("pid", F.round(F.try_divide(F.size(F.array_intersect("s", three)), F.size(F.array_union("s", three))), 6).alias("jaccard"))


@query("ml06_temporal_score", None, "enc")
def _(enc):
    """Fit on the earlier train years, scored on the last one."""
    from ..operators.calibrate import tune_threshold
    from ..operators.models import fit_ovr, score_ovr
    from .q_text import _features

    x = _features(enc).join(enc.select(F.col("pid").alias("row_id"), "year"), "row_id")
    gold = enc.select(F.col("pid").alias("row_id"), F.col("status").alias("label"))
    m = fit_ovr(x.where("year <= 1998"), gold, ["F", "O"])
    p = score_ovr(m, x.where("year = 1999")).join(gold.withColumn("y", F.lit(1)), ["row_id", "label"], "left").fillna(0, ["y"])
    return tune_threshold(p)
