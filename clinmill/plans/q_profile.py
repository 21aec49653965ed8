"""Queries over joins, profiles, windows, top-k, samples, splits, vocabularies and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import text as T
from ..functions.constants import GLOSSARY, TOKEN
from ..operators import assemble as A
from ..operators import merge as M
from ..operators import profile as P
from ..operators import split as S
from ..operators import vocab as VO
from .base import query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query("jn01_encounter_extract", "SELECT o_orderkey, o_custkey, c_name, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey", "orders", "customer", "nation", "region")
def _(o, c, n, r):
    o = o.select("o_orderkey", "o_custkey")
    c = c.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    r = r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return A.build_encounter_extract(o, c, "o_custkey", [(n, "c_nationkey"), (r, "n_regionkey")]).select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name")


@query("jn02_order_extract", "SELECT l_orderkey, l_linenumber, p_name, p_brand, s_name FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", "lineitem", "orders", "part", "supplier")
def _(li, o, p, s):
    li = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    parent = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    out = A.build_order_extract(li, parent, "l_orderkey", [(p.select("p_partkey", "p_name", "p_brand"), "p_partkey"), (s.select("s_suppkey", "s_name"), "s_suppkey")])
    return out.select("l_orderkey", "l_linenumber", "p_name", "p_brand", "s_name")


@query("jn03_link_extract", "SELECT conv_id AS doc_id, turn, substr(trim(coalesce(b.text, '')), 1, 40) AS text FROM conversations c LEFT JOIN benchmark b ON b.item_id = c.turn WHERE conv_id IN (SELECT doc_id FROM documents)", "conversations", "documents", "benchmark")
def _(cv, docs, b):
    link = cv.select(F.col("conv_id").alias("doc_id"), "turn", F.col("turn").alias("item_id"))
    return A.build_link_extract(link, docs, "doc_id", b, "item_id", "text", 40).select("doc_id", "turn", "text")


@query("jn04_parent_self_join", "SELECT c_custkey, a.n_name, b.n_name AS group_name FROM customer JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = a.n_regionkey", "customer", "nation")
def _(c, n):
    link = c.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return A.build_cc_extract(link, n, "n_nationkey", "n_regionkey", "n_name").select("c_custkey", "n_name", "group_name")


@query("jn05_cohort_history", "SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "events", "customer")
def _(ev, c):
    return A.semi(ev.select("event_id", "user_id", "value"), c.where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("jn06_so02_corpus_union", "SELECT corpus, pid, src_pid, n_name FROM (SELECT kind AS corpus, site, src_pid, src_pid + CASE kind WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 100000000 ELSE 200000000 END AS pid FROM (SELECT kind, site, row_number() OVER (PARTITION BY kind ORDER BY pid) AS src_pid FROM enc WHERE kind IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))) LEFT JOIN nation ON n_nationkey = site", "enc", "nation")
def _(enc, n):
    m = _merged(enc)
    return A.map_join(m.select("corpus", "pid", "src_pid", F.col("site").alias("n_nationkey")), n.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"), "n_nationkey").select("corpus", "pid", "src_pid", "n_name")


OFFSETS = {"1-URGENT": 0, "2-HIGH": 100_000_000, "3-MEDIUM": 200_000_000}


def _numbered(enc: DataFrame) -> DataFrame:
    """Encounters of the sister corpora, their ids counted from 1 in each corpus, beside the ids that they had (own); written once."""
    from ..sources.scratch import stored

    return stored(M.numbered(enc.where(F.col("kind").isin(*OFFSETS)), "kind", "pid", "new").withColumnsRenamed({"pid": "own", "new": "pid"}))


def _corpora(e: DataFrame) -> dict[str, DataFrame]:
    """A frame for each corpus of numbered encounters or of their children."""
    return {k: e.where(F.col("kind") == k).drop("kind", "own") for k in OFFSETS}


def _merged(enc):
    return M.merge_corpora(_corpora(_numbered(enc)), OFFSETS, ["pid"])


@query("jn07_map_join", "SELECT pid, line, p_type FROM rx LEFT JOIN part ON p_partkey = drug", "rx", "part")
def _(rx, part):
    return A.map_join(rx.select("pid", "line", "drug"), part.select(F.col("p_partkey").alias("drug"), "p_type"), "drug").select("pid", "line", "p_type")


@query("jn08_semi_jn09_anti", "SELECT (SELECT count(*) FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'train')) AS n_semi, (SELECT count(*) FROM (SELECT DISTINCT drug FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'test') AND drug NOT IN (SELECT drug FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'train')))) AS n_anti", "rx", "enc")
def _(rx, enc):
    at = lambda s: A.semi(rx, enc.where(F.col("split") == s).select("pid"), "pid")
    a = at("train").agg(F.count("*").alias("n_semi"))
    return a.join(A.anti(at("test").select("drug").distinct(), at("train").select("drug"), "drug").agg(F.count("*").alias("n_anti")))


@query("jn10_ag15_empty_profile", "SELECT CASE WHEN EXISTS (SELECT 1 FROM rx WHERE rx.pid = enc.pid) THEN 1 ELSE 0 END AS has_drug, count(*) AS n, count_if(pid IN (SELECT doc_id FROM labels)) AS with_link, count_if(trim(coalesce(note, '')) <> '') AS with_text FROM enc GROUP BY 1", "enc", "rx", "labels")
def _(enc, rx, labels):
    return P.empty_rx_profile(enc, rx, labels.select(F.col("doc_id").alias("pid")), "pid", "note")


@query("jn11_so05_pairs", "WITH d AS (SELECT DISTINCT pid, label FROM rx) SELECT a.label AS a, b.label AS b, count(*) AS n FROM d a JOIN d b ON a.pid = b.pid AND a.label < b.label GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 40", "rx")
def _(rx):
    return P.co_prescribed_pairs(rx, "pid", "label", 40)


@query("jn12_wn07_carryover", "WITH s AS (SELECT pid, list(DISTINCT label) AS s FROM rx GROUP BY pid), v AS (SELECT pid, s, lag(s) OVER (PARTITION BY uid ORDER BY visit, pid) AS p FROM enc JOIN s USING (pid)) SELECT pid, round(len(list_intersect(s, p))::DOUBLE / len(list_distinct(list_concat(s, p))), 6) AS jaccard FROM v WHERE p IS NOT NULL", "enc", "rx")
def _(enc, rx):
    return R6(A.carryover_jaccard(enc, rx, "label"), "jaccard")


@query("jn13_prior_visits", "SELECT a.pid, coalesce(array_to_string(list_reverse(list(b.pid ORDER BY b.visit DESC, b.pid DESC)[1:4]), ','), '') AS prior FROM enc a LEFT JOIN enc b ON b.uid = a.uid AND b.visit < a.visit GROUP BY a.pid", "enc")
def _(enc):
    return A.prior_visits(enc).select("pid", F.array_join(F.transform("prior", lambda x: x.cast("string")), ",").alias("prior"))


@query("jn14_jn15_join_first", "SELECT pid, e.event_id, e.value FROM enc LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) e ON e.user_id = enc.uid AND r = 1", "enc", "events")
def _(enc, ev):
    return A.join_first(enc, ev.select(F.col("user_id").alias("uid"), "event_id", "value", "ts"), "uid", "ts", "event_id").select("pid", "event_id", "value")


_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"


@query("jn17_resolve_names", f"WITH g AS (SELECT DISTINCT p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE lower(p_type) END AS name FROM part), gk AS (SELECT name, {_KEY.format('name')} AS k FROM g), f AS (SELECT p_partkey AS id, {_KEY.format('p_name')} AS k FROM part), x AS (SELECT name, min(id) AS id FROM gk JOIN f USING (k) GROUP BY name), y AS (SELECT name, min(id) AS id FROM gk JOIN f ON left(gk.k, 6) = left(f.k, 6) AND abs(length(gk.k) - length(f.k)) <= 3 WHERE length(gk.k) >= 6 AND name NOT IN (SELECT name FROM x) GROUP BY name) SELECT name, id, 'exact' AS how FROM x UNION ALL SELECT name, id, 'prefix' FROM y", "part")
def _(part):
    names = part.select(F.concat("p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "#").otherwise(F.lower("p_type"))).alias("name"))
    return A.resolve_names(names, part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("drug_name")))


@query("jn18_tk02_cosine_topk", "WITH r AS (SELECT label AS rid, min(vec_id) AS v FROM embeddings GROUP BY label), rr AS (SELECT rid, embedding AS e FROM r JOIN embeddings ON vec_id = v), s AS (SELECT vec_id AS qid, rid, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS s FROM embeddings, rr) SELECT qid, rid, round(s, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) AS rank FROM s) WHERE rank <= 3", "embeddings")
def _(em):
    refs = em.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).withColumnRenamed("label", "rid")
    return A.cosine_topk(em.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), refs, 3).withColumn("score", F.round("score", 5))


@query("jn21_benchmark_join", "WITH c AS (SELECT kind, avg(price) AS rate FROM enc GROUP BY kind), r AS (SELECT kind, arg_max(v, year) AS reference, max(year) AS ref_year FROM (SELECT kind, year, avg(price) AS v FROM enc GROUP BY kind, year) GROUP BY kind) SELECT kind, round(rate, 4) AS rate, round(reference, 4) AS reference, ref_year, round(rate - reference, 4) AS delta FROM c JOIN r USING (kind)", "enc")
def _(enc):
    out = A.benchmark_join(enc.groupBy("kind").agg(F.avg("price").alias("rate")), enc.groupBy("kind", "year").agg(F.avg("price").alias("value")), "kind")
    return out.withColumns({c: F.round(c, 4) for c in ("rate", "reference", "delta")})


@query("jn22_coder_agreement", "SELECT count(*) AS n, round(avg((a.label = b.label)::INT), 6) AS exact, round(avg((left(a.label, 1) = left(b.label, 1))::INT), 6) AS chapter FROM (SELECT pid, min(label) AS label FROM rx GROUP BY pid) a JOIN (SELECT pid, max(label) AS label FROM rx GROUP BY pid) b USING (pid)", "rx")
def _(rx):
    a, b = rx.groupBy("pid").agg(F.min("label").alias("label")), rx.groupBy("pid").agg(F.max("label").alias("label"))
    return R6(A.coder_agreement(a, b, "pid", "label"), "exact", "chapter")


# ---- aggregations


@query("ag01_volumes", "SELECT 'orders' AS \"table\", count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents", "orders", "lineitem", "events", "documents")
def _(o, li, e, d):
    return P.table_volumes({"orders": o, "lineitem": li, "events": e, "documents": d})


@query("ag02_linkage", "SELECT 'rx' AS kind, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(DISTINCT CASE WHEN l_orderkey IN (SELECT o_orderkey FROM orders) THEN l_orderkey END) AS n_valid FROM lineitem UNION ALL SELECT 'notes', count(*), count(DISTINCT doc_id), count(DISTINCT CASE WHEN doc_id IN (SELECT o_orderkey FROM orders) THEN doc_id END) FROM documents", "orders", "lineitem", "documents")
def _(o, li, d):
    k = lambda df, c: df.select(F.col(c).alias("k"))
    return P.linkage_counts(k(o, "o_orderkey"), {"rx": k(li, "l_orderkey"), "notes": k(d, "doc_id")}, "k")


@query("ag03_order_hist", "WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n_orders FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT n_orders, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM n GROUP BY n_orders", "enc", "rx")
def _(enc, rx):
    return R6(P.order_count_hist(enc, rx, "pid"), "share")


@query("ag04_set_sizes", "SELECT 'label' AS kind, round(avg(n), 6) AS mean, max(n) AS max FROM (SELECT count(DISTINCT label) AS n FROM rx GROUP BY pid) UNION ALL SELECT 'drug', round(avg(n), 6), max(n) FROM (SELECT count(DISTINCT drug) AS n FROM rx GROUP BY pid)", "rx")
def _(rx):
    return R6(P.set_sizes({"label": rx.select("pid", F.col("label").alias("i")), "drug": rx.select("pid", F.col("drug").alias("i"))}, "pid", "i"), "mean")


@query("ag05_vocab_sizes", 'SELECT * FROM (UNPIVOT (SELECT count(DISTINCT p_name) AS p_name, count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_type) AS p_type, count(DISTINCT p_size) AS p_size FROM part) ON p_name, p_brand, p_type, p_size INTO NAME "column" VALUE n_distinct)', "part")
def _(part):
    return P.vocab_sizes(part, ["p_name", "p_brand", "p_type", "p_size"])


@query("ag06_visit_bands", "WITH n AS (SELECT uid, count(*) AS n FROM enc GROUP BY uid) SELECT CASE WHEN n <= 3 THEN n::VARCHAR WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS band, count(*) AS patients, sum(n)::BIGINT AS visits FROM n GROUP BY 1", "enc")
def _(enc):
    return P.visit_bands(enc, "uid")


@query("ag07_text_availability", "SELECT 'note' AS \"column\", count(nullif(trim(coalesce(note, '')), '')) AS n_text FROM raw UNION ALL SELECT 'smoker', count(nullif(trim(coalesce(smoker, '')), '')) FROM raw UNION ALL SELECT 'sex', count(nullif(trim(coalesce(sex, '')), '')) FROM raw", "raw")
def _(raw):
    return P.text_availability(raw, ["note", "smoker", "sex"])


@query("ag08_per_year", "SELECT year, count(*) AS n FROM enc GROUP BY year", "enc")
def _(enc):
    return enc.groupBy("year").agg(F.count("*").alias("n"))


@query("ag09_prescribers", "SELECT count(*) AS n_prescribers, max(n) AS max, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median FROM (SELECT prescriber, count(*) AS n FROM rx GROUP BY prescriber)", "rx")
def _(rx):
    return R6(P.prescriber_concentration(rx, "prescriber"), "mean")


@query("ag10_length_dist", "SELECT min(length(text)) AS min, round(avg(length(text)), 6) AS mean, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.9) AS p90, round(quantile_cont(length(text), 0.99), 6) AS p99, max(length(text)) AS max FROM documents", "documents")
def _(d):
    return R6(P.length_dist(d, "text"), "mean", "p99")


@query("ag11_value_freq", "SELECT dose, count(*) AS n FROM rx GROUP BY dose ORDER BY n DESC, dose LIMIT 3", "rx")
def _(rx):
    return P.value_freq(rx, "dose", 3)


@query("ag12_dose_alias", "SELECT CASE WHEN dose LIKE 'SOS%' THEN 'sos' WHEN dose LIKE '1/2%' THEN '1/2+0+1/2' ELSE '1+0+1' END AS canon, count(DISTINCT dose) AS n_ids, count(*) AS n_rows FROM rx GROUP BY 1", "rx")
def _(rx):
    return P.dose_alias_audit(rx, "dose", C.canon_dose("dose"))


@query("ag13_demo", "SELECT count(*) AS n, count(age) AS with_age, count(sex) AS with_sex, count_if(age IS NOT NULL AND sex IS NOT NULL) AS with_both FROM enc", "enc")
def _(enc):
    return P.demo_availability(enc)


@query("ag14_site_coverage", "SELECT count(DISTINCT site) AS n_sites, count(DISTINCT n_name) AS n_named, count_if(n_name IS NULL) AS unnamed FROM enc LEFT JOIN nation ON n_nationkey = site", "enc", "nation")
def _(enc, n):
    j = enc.join(n.select(F.col("n_nationkey").cast("int").alias("site"), "n_name"), "site", "left")
    return j.agg(F.countDistinct("site").alias("n_sites"), F.countDistinct("n_name").alias("n_named"), F.count_if(F.col("n_name").isNull()).alias("unnamed"))


_tok = f"regexp_extract_all(lower(note), '{TOKEN}')"


@query("ag16_token_freq", f"SELECT token, count(*) AS freq FROM (SELECT unnest({_tok}) AS token FROM enc WHERE split = 'train' AND note NOT LIKE '<b>%') GROUP BY token", "enc")
def _(enc):
    return VO.token_freq(enc.where("split = 'train' and note not like '<b>%'"), T.tokenize("note"))


@query("ag17_vocab", f"WITH f AS (SELECT token, count(*) AS freq FROM (SELECT unnest({_tok}) AS token FROM enc WHERE note NOT LIKE '<b>%') GROUP BY token) SELECT token, (row_number() OVER (ORDER BY freq DESC, token) + 3)::BIGINT AS id, freq FROM f WHERE freq >= 2 UNION ALL SELECT unnest(['<pad>','<bos>','<eos>','<unk>']), unnest([0,1,2,3]), 0", "enc")
def _(enc):
    return VO.build_vocab(VO.token_freq(enc.where("note not like '<b>%'"), T.tokenize("note")), 2)


@query("ag18_ag19_strata", "WITH f AS (SELECT l.drug, coalesce(n, 0) AS freq FROM (SELECT DISTINCT drug FROM rx) l LEFT JOIN (SELECT drug, count(*) AS n FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'train') GROUP BY drug) USING (drug)) SELECT CASE WHEN freq >= 100 THEN 'head' WHEN freq >= 10 THEN 'mid' WHEN freq >= 1 THEN 'tail' ELSE 'unseen' END AS stratum, count(*) AS n, sum(freq)::BIGINT AS orders FROM f GROUP BY 1", "rx", "enc")
def _(rx, enc):
    f = VO.drug_freq(rx, enc.where("split = 'train'"), "pid", "drug")
    return f.groupBy(VO.stratum(F.col("freq")).alias("stratum")).agg(F.count("*").alias("n"), F.sum("freq").alias("orders"))


@query("ag20_norm_stats", "SELECT 'price' AS \"column\", round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, round(avg((price IS NULL)::INT), 6) AS missing FROM enc WHERE split = 'train' UNION ALL SELECT 'age', round(avg(age), 4), round(stddev_samp(age), 4), round(avg((age IS NULL)::INT), 6) FROM enc WHERE split = 'train'", "enc")
def _(enc):
    return VO.norm_stats(enc, ["price", "age"]).select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("missing", 6).alias("missing"))


@query("ag22_ag23_mode_fold", "WITH m AS (SELECT pid, form FROM (SELECT pid, form, row_number() OVER (PARTITION BY pid ORDER BY count(*) DESC, form) AS r FROM rx GROUP BY pid, form) WHERE r = 1), t AS (SELECT form FROM m JOIN enc USING (pid) WHERE split = 'train' GROUP BY form ORDER BY count(*) DESC, form LIMIT 2) SELECT pid, CASE WHEN form IN (SELECT form FROM t) THEN form ELSE 'OTHER' END AS form FROM m", "rx", "enc")
def _(rx, enc):
    m = VO.mode_per_key(rx, "pid", "form").join(enc.select("pid", "split"), "pid")
    return VO.fold_rare(m, "form", 2, F.col("split") == "train").select("pid", "form")


@query("ag24_top_classes", "SELECT label, count(DISTINCT pid) AS support FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'train') GROUP BY label ORDER BY support DESC, label LIMIT 20", "rx", "enc")
def _(rx, enc):
    return VO.top_classes(rx, enc.where("split = 'train'"), "pid", "label", 20)


@query("ag25_count_targets", "SELECT pid, (SELECT count(*) FROM rx WHERE rx.pid = enc.pid) AS n_drugs, (SELECT count(*) FROM conversations WHERE conv_id = enc.pid) AS n_advice FROM enc", "enc", "rx", "conversations")
def _(enc, rx, cv):
    return VO.count_targets(enc, {"n_drugs": rx, "n_advice": cv.select(F.col("conv_id").alias("pid"))}, "pid")


@query("ag26_multi_hot", "SELECT pid, " + ", ".join(f"max(CASE WHEN label = 'c{k}' THEN 1 ELSE 0 END) AS c{k}" for k in range(10)) + " FROM enc LEFT JOIN rx USING (pid) GROUP BY pid", "enc", "rx")
def _(enc, rx):
    return VO.multi_hot(enc, rx, "pid", "label", [f"c{k}" for k in range(10)])


@query("ag36_abbreviation_load", "WITH t AS (SELECT pid, unnest(" + _tok + ") AS token FROM enc WHERE note NOT LIKE '<b>%'), g AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in GLOSSARY) + "]) AS token) SELECT count(*) AS tokens, count_if(token IN (SELECT token FROM g)) AS abbreviations, count(DISTINCT CASE WHEN token IN (SELECT token FROM g) THEN pid END) AS notes, count(DISTINCT CASE WHEN token IN (SELECT token FROM g) THEN token END) AS entries FROM t", "enc")
def _(enc):
    t = enc.where("note not like '<b>%'").select("pid", F.explode(T.tokenize("note")).alias("token"))
    hit = F.col("token").isin(*GLOSSARY)
    return t.agg(F.count("*").alias("tokens"), F.count_if(hit).alias("abbreviations"), F.countDistinct(F.when(hit, F.col("pid"))).alias("notes"), F.countDistinct(F.when(hit, F.col("token"))).alias("entries"))


@query("ag41_mine_abbreviations", "WITH t AS (SELECT unnest(regexp_extract_all(note, '\\b[A-Z]{2,5}\\b')) AS token FROM enc) SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 60", "enc")
def _(enc):
    t = enc.select(F.explode(F.regexp_extract_all("note", F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0))).alias("token"))
    return P.value_freq(t, "token", 60)


@query("ag42_term_contrast", "SELECT contains(lower(note), 'pain') AS has_term, count(price) AS n, round(avg(price), 4) AS mean FROM enc GROUP BY 1", "enc")
def _(enc):
    return P.term_contrast(enc, "note", "pain", "price").withColumn("mean", F.round("mean", 4))


@query("ag44_diversity", "WITH s AS (SELECT pid, array_to_string(list_sort(list(DISTINCT label)), ',') AS s FROM rx GROUP BY pid), n AS (SELECT s, count(*) AS n FROM s GROUP BY s) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_sets, round(max(n)::DOUBLE / sum(n), 6) AS modal_share FROM n", "rx")
def _(rx):
    return R6(P.set_diversity(rx, "pid", "label"), "modal_share")


@query("ag45_seed_summary", "SELECT kind, status, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std FROM enc GROUP BY kind, status", "enc")
def _(enc):
    return P.seed_summary(enc, ["kind", "status"], "price").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("pf25_fk_quality", "SELECT 'drug' AS \"column\", count_if(drug IS NULL) AS n_null, count_if(drug = 0) AS n_zero, count_if(drug IS NOT NULL AND drug NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)) AS n_orphan FROM rx UNION ALL SELECT 'prescriber', count_if(prescriber IS NULL), count_if(prescriber = 0), count_if(prescriber NOT IN (SELECT s_suppkey FROM supplier)) FROM rx", "rx", "part", "supplier")
def _(rx, part, sup):
    return P.fk_quality(rx, {"drug": part.where("p_size < 40").select("p_partkey"), "prescriber": sup.select("s_suppkey")})


@query("pf26_completeness", "SELECT 'bmi' AS \"column\", round(100.0 * count(bmi) / count(*), 6) AS pct FROM raw UNION ALL SELECT 'bp_sys', round(100.0 * count(bp_sys) / count(*), 6) FROM raw UNION ALL SELECT 'smoker', round(100.0 * count(smoker) / count(*), 6) FROM raw", "raw")
def _(raw):
    return R6(P.completeness(raw, ["bmi", "bp_sys", "smoker"]), "pct")


# ---- windows, top-k, samples


@query("wn01_share", "SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rx GROUP BY label", "rx")
def _(rx):
    return R6(P.share_of_total(rx, "label"), "share")


@query("wn02_concentration", "WITH n AS (SELECT drug, count(*) AS n FROM rx GROUP BY drug), r AS (SELECT row_number() OVER (ORDER BY n DESC, drug) AS k, sum(n) OVER (ORDER BY n DESC, drug ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER () AS total FROM n) SELECT k, round(run::DOUBLE / total, 6) AS share FROM r WHERE k IN (1, 5, 10, 50, 100, 500)", "rx")
def _(rx):
    return R6(P.label_concentration(rx, "drug", [1, 5, 10, 50, 100, 500]), "share")


@query("wn03_visit_rank", "SELECT pid, uid, row_number() OVER (PARTITION BY uid ORDER BY visit, pid) AS rn FROM enc", "enc")
def _(enc):
    return A.visit_rank(enc, "uid", "visit", "pid").select("pid", "uid", "rn")


@query("wn04_wn06_visit_features", "SELECT pid, row_number() OVER w - 1 AS visit_idx, CASE WHEN row_number() OVER w = 1 THEN 1 ELSE 0 END AS first_visit, visit - lag(visit) OVER w AS days_since_prev, lag(status) OVER w AS prev_outcome FROM enc WINDOW w AS (PARTITION BY uid ORDER BY visit, pid)", "enc")
def _(enc):
    return A.visit_features(enc, "status").select("pid", "visit_idx", "first_visit", "days_since_prev", "prev_outcome")


@query("wn08_canonical_order", "WITH f AS (SELECT drug, count(*) AS freq FROM rx WHERE pid IN (SELECT pid FROM enc WHERE split = 'train') GROUP BY drug) SELECT pid, drug, row_number() OVER (PARTITION BY pid ORDER BY coalesce(freq, 0) DESC, drug) AS pos FROM (SELECT DISTINCT pid, drug FROM rx) LEFT JOIN f USING (drug)", "rx", "enc")
def _(rx, enc):
    return VO.canonical_order(rx, VO.drug_freq(rx, enc.where("split = 'train'"), "pid", "drug"), "pid", "drug")


@query("wn10_calendar", "SELECT pid, month(visit)::INT AS month, round(sin(2 * pi() * month(visit) / 12), 6) AS month_sin, round(cos(2 * pi() * month(visit) / 12), 6) AS month_cos, CASE WHEN month(visit) IN (12, 1, 2) THEN 'winter' WHEN month(visit) <= 5 THEN 'summer' WHEN month(visit) <= 9 THEN 'monsoon' ELSE 'autumn' END AS season, (isodow(visit) - 1)::INT AS weekday, visit - (SELECT min(visit) FROM enc WHERE split = 'train') AS days_since_start FROM enc", "enc")
def _(enc):
    return R6(A.calendar(enc, "visit").select("pid", "month", "month_sin", "month_cos", "season", "weekday", "days_since_start"), "month_sin", "month_cos")


@query("tk01_top_k", "SELECT drug, count(*) AS n FROM rx GROUP BY drug ORDER BY n DESC, drug LIMIT 25", "rx")
def _(rx):
    return P.value_freq(rx, "drug", 25)


def _hex(seed, *cols):
    return "('0x' || substr(md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"{c}::VARCHAR" for c in cols) + ")), 1, 8))::BIGINT"


@query("tk05_stratified_sample", f"SELECT pid, kind FROM (SELECT pid, kind, row_number() OVER (PARTITION BY kind ORDER BY {_hex(42, 'pid')}, pid) AS r FROM enc) WHERE r <= CASE kind WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 20 ELSE 10 END", "enc")
def _(enc):
    from ..operators.sample import stratified_sample

    return stratified_sample(enc, "kind", "pid", {"1-URGENT": 30, "2-HIGH": 20}, 10, 42).select("pid", "kind")


@query("tk06_pairwise_sample", f"SELECT pid, has_drug FROM (SELECT *, row_number() OVER (PARTITION BY has_drug ORDER BY {_hex(7, 'pid')}, pid) AS r FROM (SELECT pid, CASE WHEN pid IN (SELECT pid FROM rx) THEN 1 ELSE 0 END AS has_drug FROM enc)) WHERE r <= CASE has_drug WHEN 0 THEN 10 ELSE 40 END", "enc", "rx")
def _(enc, rx):
    from ..operators.sample import pairwise_sample

    return pairwise_sample(enc, rx, "pid", 10, 40, 7)


@query("tk07_strata_draw", f"WITH s AS (SELECT pid, CASE WHEN note = '' THEN 'declined' WHEN length(note) < 12 THEN 'sparse' WHEN pid NOT IN (SELECT pid FROM rx) THEN 'empty' ELSE 'rest' END AS stratum FROM enc) SELECT pid, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_hex(3, 'pid')}, pid) AS r FROM s) WHERE r <= 5", "enc", "rx")
def _(enc, rx):
    from ..operators.sample import strata_draw

    e = enc.join(rx.select("pid").distinct().withColumn("__rx", F.lit(1)), "pid", "left")
    return strata_draw(e, [("declined", F.col("note") == ""), ("sparse", F.length("note") < 12), ("empty", F.col("__rx").isNull())], "pid", 5, 3).select("pid", "stratum")


@query("tk08_holdout_keys", f"SELECT p_partkey FROM part ORDER BY {_hex(11, 'p_partkey')}, p_partkey LIMIT 60", "part")
def _(part):
    from ..operators.sample import holdout_keys

    return holdout_keys(part, "p_partkey", 60, 11)


@query("tk09_exemplars", f"WITH c AS (SELECT pid, note, CASE WHEN pid IN (SELECT pid FROM rx) THEN 1 ELSE 0 END AS has_drug FROM enc WHERE split = 'train'), q AS (SELECT round(12 * avg(1 - has_drug))::INT AS n_empty FROM c) SELECT pid, has_drug FROM (SELECT *, row_number() OVER (PARTITION BY has_drug ORDER BY {_hex(5, 'pid')}, pid) AS r FROM c), q WHERE r <= CASE has_drug WHEN 0 THEN least(n_empty, 11) ELSE 12 - least(n_empty, 11) END", "enc", "rx")
def _(enc, rx):
    from ..operators.sample import exemplars

    return exemplars(enc.where("split = 'train'"), rx, "pid", 12, 5)


@query("tk10_formulary", "SELECT drug, n, p_type FROM (SELECT drug, count(*) AS n FROM rx GROUP BY drug ORDER BY n DESC, drug LIMIT 50) JOIN part ON p_partkey = drug", "rx", "part")
def _(rx, part):
    return A.map_join(P.value_freq(rx, "drug", 50), part.select(F.col("p_partkey").alias("drug"), "p_type"), "drug")


@query("tk12_samples", "SELECT doc_id, left(text, 60) AS head FROM documents ORDER BY doc_id LIMIT 20", "documents")
def _(d):
    return P.examples(d.select("doc_id", F.left("text", F.lit(60)).alias("head")), 20, "doc_id")


# ---- sets


@query("so01_misc_vocab", "SELECT 'nation' AS kind, n_nationkey::BIGINT AS id, n_name AS val FROM nation UNION ALL SELECT 'region', r_regionkey::BIGINT, r_name FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier", "nation", "region", "supplier")
def _(n, r, s):
    k = lambda df, kind, i, v: df.select(F.lit(kind).alias("kind"), F.col(i).cast("long").alias("id"), F.col(v).alias("val"))
    return k(n, "nation", "n_nationkey", "n_name").unionByName(k(r, "region", "r_regionkey", "r_name")).unionByName(k(s, "supplier", "s_suppkey", "s_name"))


@query("so04_vocab_overlap", "WITH a AS (SELECT DISTINCT drug FROM rx JOIN enc USING (pid) WHERE year <= 1996 AND drug % 3 < 2), b AS (SELECT DISTINCT drug FROM rx JOIN enc USING (pid) WHERE year >= 2000 AND drug % 3 > 0) SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_any, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n_new, round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b))::DOUBLE / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard", "rx", "enc")
def _(rx, enc):
    from ..operators.drift import vocab_overlap

    j = rx.join(enc.select("pid", "year"), "pid")
    return R6(vocab_overlap(j.where("year <= 1996 and drug % 3 < 2").select("drug"), j.where("year >= 2000 and drug % 3 > 0").select("drug")), "jaccard")


@query("so06_so07_pairs", "SELECT DISTINCT pid, label FROM rx WHERE label IN ('c1','c2','c3')", "rx")
def _(rx):
    return A.semi(rx.select("pid", "label").distinct(), rx.select("label").where(F.col("label").isin("c1", "c2", "c3")).distinct(), "label").select("pid", "label")


# ---- splits


@query("sp01_patient_split", f"WITH p AS (SELECT uid, row_number() OVER (ORDER BY {_hex(42, 'uid')}, uid) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT uid FROM enc)) SELECT uid, CASE WHEN r <= floor(n * 0.2) THEN 'test' WHEN r <= floor(n * 0.2) + floor(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM p", "enc")
def _(enc):
    return S.patient_split(enc, "uid")


@query("sp02_temporal_split", "SELECT pid, CASE WHEN year <= 1999 THEN 'train' WHEN year <= 2000 THEN 'val' ELSE 'test' END AS split FROM enc", "enc")
def _(enc):
    return enc.select("pid", S.temporal_split(F.col("year"), 1999, 2000).alias("split"))


@query("sp03_frozen_split", f"WITH old AS (SELECT DISTINCT uid, CASE WHEN uid % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM enc WHERE uid % 3 > 0), p AS (SELECT uid, row_number() OVER (ORDER BY {_hex(42, 'uid')}, uid) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT uid FROM enc WHERE uid % 3 = 0)) SELECT uid, split FROM old UNION ALL SELECT uid, CASE WHEN r <= floor(n * 0.2) THEN 'test' WHEN r <= floor(n * 0.2) + floor(n * 0.1) THEN 'val' ELSE 'train' END FROM p", "enc")
def _(enc):
    old = enc.where("uid % 3 > 0").select("uid", F.when(F.col("uid") % 5 == 0, "test").otherwise("train").alias("split")).distinct()
    return S.frozen_split(enc, old, "uid")


@query("sp04_straddlers", "SELECT uid, count(DISTINCT split) AS n_splits FROM enc GROUP BY uid HAVING count(DISTINCT split) > 1", "enc")
def _(enc):
    return S.straddlers(enc, "uid")


@query("sp05_leak_report", "SELECT split, count(*) AS n, min(year) AS first, max(year) AS last, count(DISTINCT year) AS n_years, 0::BIGINT AS shared FROM enc GROUP BY split", "enc")
def _(enc):
    return S.leak_report(enc, "pid", "year")


@query("sp06_split_drift", "WITH b AS (SELECT pid, CASE WHEN pid % 5 = 0 THEN 'test' ELSE 'train' END AS new FROM enc) SELECT split AS old, new, count(*) AS n, split <> new AS moved FROM enc JOIN b USING (pid) GROUP BY 1, 2", "enc")
def _(enc):
    return S.split_drift(enc, enc.select("pid", F.when(F.col("pid") % 5 == 0, "test").otherwise("train").alias("split")), "pid")


@query("sp07_split_overlap", "SELECT count(*) AS n FROM enc WHERE split = 'test' AND pid % 5 = 0", "enc")
def _(enc):
    return S.split_overlap(enc, enc.select("pid", F.when(F.col("pid") % 5 == 0, "test").otherwise("train").alias("split")), "pid")


# ---- merge proofs


def _proof(enc, rx):
    """The proofs over encounters and their orders: each order is a child of the encounter that it was written for, under that one's new id."""
    from ..sources.scratch import spread, stored

    e, of = _numbered(enc), rx.select("pid").unionAll(enc.select("pid"))
    parents = spread(e.select("own", "kind", "pid"), "own", of=of).hint("merge")  # as many as the rows, see _known of q_score
    orders = spread(rx.select(F.col("pid").alias("own")), "own", of=of)
    parts, child = _corpora(e), _corpora(stored(orders.join(parents, "own").select("kind", "pid")))
    return M.verify_ids(parts, M.merge_corpora(parts, OFFSETS, ["pid"]), "pid", OFFSETS, {"rx": (child, M.merge_corpora(child, OFFSETS, ["pid"]))})


@query("cm01_cm11_proofs", "SELECT c AS \"check\", true AS passed, CASE WHEN c = 'collision_is_real' THEN (SELECT count(*)::VARCHAR FROM (SELECT r FROM (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY pid) AS r FROM enc WHERE kind IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) GROUP BY r HAVING count(DISTINCT kind) > 1)) ELSE '0' END AS detail FROM (SELECT unnest(['collision_is_real','merged_id_unique','bijection','source_ids_round_trip','blocks_disjoint','no_id_crosses_corpora','no_child_re_parented_rx','resolution_rx','slice_equals_source_1-URGENT','slice_equals_source_2-HIGH','slice_equals_source_3-MEDIUM']) AS c)", "enc", "rx")
def _(enc, rx):
    return _proof(enc, rx)


@query("ag28_ag30_corpus_totals", "WITH n AS (SELECT pid, count(*) AS k FROM rx GROUP BY pid), l AS (SELECT kind AS corpus, count(DISTINCT label) AS n_labels FROM enc JOIN rx USING (pid) GROUP BY 1) SELECT kind AS corpus, count(*) AS encounters, count(DISTINCT uid) AS patients, coalesce(sum(k), 0)::BIGINT AS orders, round(avg((k IS NULL)::INT), 6) AS zero_drug, round(avg((trim(note) <> '')::INT), 6) AS with_text, count(DISTINCT site) AS sites, min(year) AS first_year, max(year) AS last_year, any_value(n_labels) AS n_labels FROM enc LEFT JOIN n USING (pid) LEFT JOIN l ON l.corpus = kind GROUP BY kind", "enc", "rx")
def _(enc, rx):
    return R6(M.corpus_totals(enc.withColumnRenamed("kind", "corpus"), rx, "pid"), "zero_drug", "with_text")


@query("ag30_text_coverage", f"WITH t AS (SELECT kind AS corpus, length(trim(note)) AS chars, {_tok} AS tok FROM enc WHERE note NOT LIKE '<b>%'), v AS (SELECT corpus, count(DISTINCT w) AS vocabulary FROM (SELECT corpus, unnest(tok) AS w FROM t) GROUP BY corpus) SELECT corpus, count_if(chars > 0) AS with_text, round(avg(chars), 6) AS mean_chars, sum(len(tok))::BIGINT AS tokens, any_value(vocabulary) AS vocabulary FROM t JOIN v USING (corpus) GROUP BY corpus", "enc")
def _(enc):
    return R6(M.text_coverage(enc.where("note not like '<b>%'").withColumnRenamed("kind", "corpus"), "note", T.tokenize("note")), "mean_chars")


@query("ag31_category_shift", "WITH s AS (SELECT status, label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY status) AS s FROM rx JOIN enc USING (pid) WHERE status IN ('F', 'O') GROUP BY 1, 2) SELECT label, round(coalesce(max(CASE WHEN status = 'F' THEN s END), 0), 6) AS share_a, round(coalesce(max(CASE WHEN status = 'O' THEN s END), 0), 6) AS share_b, round(coalesce(max(CASE WHEN status = 'O' THEN s END), 0) - coalesce(max(CASE WHEN status = 'F' THEN s END), 0), 6) AS delta FROM s GROUP BY label", "rx", "enc")
def _(rx, enc):
    return R6(M.category_shift(rx.join(enc.select("pid", "status"), "pid"), "status", "label", "F", "O"), "share_a", "share_b", "delta")


@query("ag32_new_labels", "WITH j AS (SELECT drug, status FROM rx JOIN enc USING (pid) WHERE NOT (status = 'F' AND drug % 7 = 0)) SELECT drug, count(*) AS n FROM j WHERE status = 'O' AND drug NOT IN (SELECT drug FROM j WHERE status = 'F') GROUP BY drug", "rx", "enc")
def _(rx, enc):
    return M.new_labels(rx.join(enc.select("pid", "status"), "pid").where("not (status = 'F' and drug % 7 = 0)"), "status", "drug", "F", "O")


@query("ag33_ag34_strata_moves", "WITH f AS (SELECT drug, count(*) FILTER (status = 'F') AS a, count(*) AS b FROM rx JOIN enc USING (pid) GROUP BY drug) SELECT CASE WHEN a >= 100 THEN 'head' WHEN a >= 10 THEN 'mid' WHEN a >= 1 THEN 'tail' ELSE 'unseen' END AS before, CASE WHEN b >= 100 THEN 'head' WHEN b >= 10 THEN 'mid' WHEN b >= 1 THEN 'tail' ELSE 'unseen' END AS after, count(*) AS n FROM f GROUP BY 1, 2", "rx", "enc")
def _(rx, enc):
    j = rx.join(enc.select("pid", "status"), "pid")
    f = lambda d: d.groupBy("drug").agg(F.count("*").alias("freq"))
    return M.strata_moves(f(j.where("status = 'F'")), f(j), "drug", VO.stratum)


@query("ag35_split_counts", "SELECT kind AS corpus, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM enc GROUP BY kind", "enc")
def _(enc):
    return M.split_counts(enc.withColumnRenamed("kind", "corpus"))


@query("ag47_merge_warnings", "SELECT kind, min(year) AS first, max(year) AS last, count(DISTINCT site) AS sites, round(avg((sex = 'M')::INT), 6) AS male, count(DISTINCT CASE WHEN uid IN (SELECT uid FROM enc e WHERE e.kind <> enc.kind) THEN uid END) AS shared FROM enc GROUP BY kind", "enc")
def _(enc):
    shared = enc.select("uid", "kind").distinct().groupBy("uid").agg(F.count("*").alias("k"))
    return R6(enc.join(shared, "uid").groupBy("kind").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.countDistinct("site").alias("sites"), F.avg((F.col("sex") == "M").cast("double")).alias("male"), F.countDistinct(F.when(F.col("k") > 1, F.col("uid"))).alias("shared")), "male")
