"""Queries over text, drug names, features, annotation, models, streaming and artefacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import CONCEPTS, GLOSSARY, SPELLING, SPELLING_EXEMPT, TOKEN
from ..operators import annotate as AN
from ..operators import assemble as A
from ..operators import drugs as DN
from ..operators import features as FE
from ..operators import metrics as EV
from ..operators import vocab as VO
from .base import ORACLE_SQL, QUERIES, query
from .q_clean import TYPED, _seen

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
ORDER = sorted(GLOSSARY, key=len, reverse=True)

NORM = "trim(regexp_replace(regexp_replace(coalesce(note, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_t = f"regexp_extract_all(lower({NORM}), '{TOKEN}')"


def _spaced(c: str) -> str:
    for k in ORDER:
        c = f"regexp_replace({c}, '\\b{re.escape(k)}\\b', '{GLOSSARY[k]}', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("tx01_tx02_norm_text", f"SELECT pid, {NORM} AS text FROM enc", "enc")
def _(enc):
    return enc.select("pid", T.norm_text("note").alias("text"))


@query("tx01_tx02_compatible", None, "documents")
def _(docs):
    return docs.select("doc_id", F.md5(T.norm_text("text", compatible=True)).alias("digest"))


@query("tx03_tokens", f"SELECT pid, array_to_string({_t}, ' ') AS tokens FROM enc", "enc")
def _(enc):
    return enc.select("pid", F.array_join(T.tokenize("note"), " ").alias("tokens"))


@query("tx07_norm_name", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(trim(lower(' .' || p_name || '®  ' || p_brand || '- ')), '[®™]', '', 'g'), '\\s+', ' ', 'g'), '^[ .\\-]+|[ .\\-]+$', '', 'g') AS key FROM part", "part")
def _(part):
    return part.select("p_partkey", T.norm_name(F.concat(F.lit(" ."), "p_name", F.lit("®  "), "p_brand", F.lit("- "))).alias("key"))


@query("tx09_glossary_spaced", f"SELECT pid, {_spaced('lower(note)')} AS text FROM enc", "enc")
def _(enc):
    return VO.per_value(enc.select("pid", "note"), "note", {"text": T.expand_glossary("note")}).drop("note")


def _single(c: str) -> str:
    """One pass over the distinct notes: each word that is a key, by its place in the text."""
    alts = "|".join(re.escape(k) for k in ORDER)
    cases = " ".join(f"WHEN '{k}' THEN '{T.joined(v)}'" for k, v in GLOSSARY.items())
    return f"array_to_string(list_transform(regexp_extract_all(' ' || {c}, '\\b(?:{alts})\\b|[a-z0-9]+|[^a-z0-9]+'), lambda x: CASE x {cases} ELSE x END), '')"


@query("tx10_glossary_joined", f"SELECT pid, trim(regexp_replace({_single('lower(note)')}, '\\s+', ' ', 'g')) AS text FROM enc", "enc")
def _(enc):
    return enc.select("pid", T.expand_glossary("note", "joined").alias("text"))


def _canonical(c: str, both: bool) -> str:
    """Like _single, with the phrases that spell an expansion out; both keeps what is replaced."""
    alts = "|".join(re.escape(k) for k in ORDER)
    cases = " ".join(f"WHEN '{k}' THEN '{k + ' ' if both else ''}{T.joined(v)}'" for k, v in GLOSSARY.items())
    c = f"array_to_string(list_transform(regexp_extract_all(' ' || {c}, '\\b(?:{alts})\\b|[a-z0-9]+|[^a-z0-9]+'), lambda x: CASE x {cases} ELSE x END), '')"
    for t in sorted({T.joined(v) for v in GLOSSARY.values() if "_" in T.joined(v)}, key=lambda t: -len(t)):
        c = f"regexp_replace({c}, '\\b{t.replace('_', '[^a-z0-9_]+')}\\b', '{chr(92) + '0 ' if both else ''}{t}', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("tx10_glossary_canonical", f"WITH n AS (SELECT note, {_canonical('lower(note)', False)} AS canonical, {_canonical('lower(note)', True)} AS augmented FROM (SELECT DISTINCT note FROM enc)) SELECT pid, canonical, augmented FROM enc JOIN n USING (note)", "enc")
def _(enc):
    return enc.select("pid", T.expand_glossary("note", "canonical").alias("canonical"), T.expand_glossary("note", "canonical_augmented").alias("augmented"))


@query("tx11_tokens_joined", f"SELECT pid, array_to_string(regexp_extract_all(trim(regexp_replace({_single('lower(note)')}, '\\s+', ' ', 'g')), '[a-z]+(?:_[a-z]+)+|{TOKEN}'), ' ') AS tokens FROM enc WHERE note NOT LIKE '<b>%'", "enc")
def _(enc):
    return enc.where("note not like '<b>%'").select("pid", F.array_join(T.tokenize_joined(T.expand_glossary("note", "joined")), " ").alias("tokens"))


_us = "CASE WHEN w IN (" + ", ".join(f"'{w}'" for w in SPELLING_EXEMPT) + ") THEN w " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN regexp_replace(w, '{p}', '{n.replace('$1', chr(92) + '1')}')" for p, n in SPELLING) + " ELSE w END"


@query("tx12_orthography", f"WITH w AS (SELECT DISTINCT unnest({_t}) AS w FROM enc) SELECT w, {_us} AS us FROM w", "enc")
def _(enc):
    return enc.select(F.explode(T.tokenize("note")).alias("w")).distinct().select("w", T.orthography_word("w").alias("us"))


VOCAB = f"v AS (SELECT token AS word, count(*) AS freq FROM (SELECT unnest({_t}) AS token FROM enc WHERE split = 'train' AND pid % 5 > 0) WHERE regexp_full_match(token, '[a-z]{{3,}}') GROUP BY token HAVING count(*) >= 5), tk AS (SELECT DISTINCT left(word, 2) || substr(word, 4) AS token, CASE WHEN length(word) - 1 < 4 THEN 0 WHEN length(word) - 1 <= 6 THEN 1 ELSE 2 END AS b FROM v)"


def _vocab(enc):
    tok = enc.where("split = 'train' and pid % 5 > 0").select(F.explode(T.tokenize("note")).alias("word")).where(F.col("word").rlike("^[a-z]{3,}$"))
    return tok.groupBy("word").agg(F.count("*").alias("freq")).where("freq >= 5")


def _budget(c):
    n = F.length(c)
    return F.when(n < 4, 0).when(n <= 6, 1).otherwise(2)


def _typos(enc):
    v = _vocab(enc)
    return A.fuzzy_token_join(v.select(F.concat(F.left("word", F.lit(2)), F.substring("word", 4, 99)).alias("token")).distinct(), v, _budget("token"))


@query("jn16_fuzzy_join", f"WITH {VOCAB} SELECT token, word, levenshtein(token, word)::INT AS dist FROM tk JOIN v ON left(token, 1) = left(word, 1) AND abs(length(token) - length(word)) <= b WHERE levenshtein(token, word) <= b AND token <> word", "enc")
def _(enc):
    return _typos(enc).select("token", "word", "dist")


@query("tx13_tx14_typo_map", f"WITH {VOCAB}, j AS (SELECT token, word, freq, levenshtein(token, word) AS d FROM tk JOIN v ON left(token, 1) = left(word, 1) AND abs(length(token) - length(word)) <= b WHERE levenshtein(token, word) <= b AND token <> word) SELECT token, word FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY d, freq DESC, word) AS r FROM j) WHERE r = 1", "enc")
def _(enc):
    return _typos(enc).groupBy("token").agg(F.min_by("word", F.struct("dist", -F.col("freq"), "word")).alias("word"))


@query("tx15_apply_map", f"WITH s AS (SELECT pid, unnest(regexp_extract_all(lower({NORM}), '[a-z]+|[^a-z]+')) AS x, generate_subscripts(regexp_extract_all(lower({NORM}), '[a-z]+|[^a-z]+'), 1) AS i FROM enc), m AS (SELECT w, {_us} AS us FROM (SELECT DISTINCT x AS w FROM s)) SELECT pid, string_agg(coalesce(us, x), '' ORDER BY i) AS text FROM s LEFT JOIN m ON m.w = x GROUP BY pid", "enc")
def _(enc):
    e = enc.withColumn("t", F.lower(T.norm_text("note"))).where("t <> ''")
    return e.select("pid", T.orthography("t").alias("text"))


@query("tx16_normaliser", f"SELECT DISTINCT note, {_spaced(f'lower({NORM})')} AS text FROM enc", "enc")
def _(enc):
    return enc.select("note").distinct().select("note", T.expand_glossary(T.norm_text("note")).alias("text"))


@query("tx17_no_complaint", "SELECT DISTINCT note, note IN ('general check up', 'NO', 'Nil', 'no specific complaints.') AS span_level, note IN ('general check up', 'NO', 'Nil', 'healthy', 'no specific complaints.') AS note_level FROM enc", "enc")
def _(enc):
    return enc.select("note").distinct().select("note", T.is_no_complaint("note").alias("span_level"), T.is_no_complaint("note", "note").alias("note_level"))


_none = "('', 'general check up', 'NO', 'Nil', 'no specific complaints.')"
_glue = "list_reduce(p, lambda a, x: a || CASE WHEN length(x) < 3 THEN ' ' ELSE '|' END || x)"
SPANS = f"""ps AS (SELECT note, list_filter(list_transform(regexp_split_to_array(regexp_replace(note, '(^|\\s)[0-9]\\.\\s+', ';', 'g'), '[,;+&]'), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT DISTINCT note FROM enc)),
sp AS (SELECT note, CASE WHEN note IN {_none} THEN '' ELSE {_glue} END AS spans FROM ps WHERE note IN {_none} OR len(p) > 0),
sl AS (SELECT note, spans, CASE WHEN spans = '' THEN [] ELSE string_split(spans, '|') END AS s FROM sp)"""
_left = "trim(regexp_replace(regexp_replace(lower(x), '\\s+(for|since)\\s+(last\\s+)?([0-9]+\\s+(days|months|years)|several weeks|long time)$', ''), '[^a-z0-9/]+', ' ', 'g'))"
_st = f"regexp_extract_all(lower(x), '{TOKEN}')"
_both = f"list_concat({_st}, list_transform(range(1, len({_st})), lambda i: ({_st})[i] || '|' || ({_st})[i + 1]))"


@query("tx18_tx19_segment", f"WITH {SPANS} SELECT pid, spans FROM enc JOIN sl USING (note)", "enc")
def _(enc):
    return enc.select("pid", F.array_join(T.segment("note"), "|").alias("spans"))


@query("tx20_tx21_span_terms", f"WITH {SPANS}, t AS (SELECT note, array_to_string(list_transform(s, lambda x: {_left}), '|') AS keys, array_to_string(list_concat(flatten(list_transform(s, lambda x: {_both})), ['__n' || least(len(s), 5)]), ' ') AS terms FROM sl) SELECT pid, keys, terms FROM enc JOIN t USING (note)", "enc")
def _(enc):
    s = enc.select("pid", T.segment("note").alias("s"))
    return s.select("pid", F.array_join(T.span_keys("s"), "|").alias("keys"), F.array_join(T.segmented_terms("s"), " ").alias("terms"))


@query("tx22_uni_bigrams", f"SELECT pid, array_to_string(list_concat({_t}, list_transform(range(1, len({_t})), lambda i: ({_t})[i] || '|' || ({_t})[i + 1])), ' ') AS terms FROM enc", "enc")
def _(enc):
    return enc.select("pid", F.array_join(T.uni_bigrams(T.tokenize("note")), " ").alias("terms"))


@query("tx23_note_shape", f"SELECT pid, (note <> '')::INT AS has_text, length(note) AS chars, len(string_split_regex(trim(note), '\\s+')) AS words, len({_t}) AS tokens, len(regexp_extract_all(note, '[,;]')) AS items FROM enc", "enc")
def _(enc):
    return enc.select("pid", (F.col("note") != "").cast("int").alias("has_text"), F.length("note").alias("chars"), F.size(F.split(F.trim("note"), r"\s+")).alias("words"), F.size(T.tokenize("note")).alias("tokens"), F.regexp_count("note", F.lit("[,;]")).alias("items"))


@query("tx24_concept_flags", f"WITH x AS (SELECT pid, lower({_spaced('lower(note)')}) AS t FROM enc) SELECT pid, " + ", ".join(f"regexp_matches(t, '{p}')::INT AS {k}" for k, p in CONCEPTS.items()) + " FROM x", "enc")
def _(enc):
    flags = lambda d: d.withColumn("t", F.lower(T.expand_glossary("note"))).select("note", *(F.col("t").rlike(p).cast("int").alias(k) for k, p in CONCEPTS.items()))
    return VO.per_value(enc.select("pid", "note"), "note", flags).drop("note")


TERMS = f"tm AS (SELECT pid AS row_id, unnest({_t}) AS term, split FROM enc)"
TFIDF = f"{TERMS}, n AS (SELECT count(DISTINCT row_id) AS n FROM tm WHERE split = 'train'), idf AS (SELECT term, ln((1 + any_value(n)) / (1.0::DOUBLE + count(DISTINCT row_id))) + 1 AS idf FROM tm, n WHERE split = 'train' GROUP BY term HAVING count(DISTINCT row_id) >= 2), tf AS (SELECT row_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM tm JOIN idf USING (term) GROUP BY 1, 2)"


def _terms(enc):
    return enc.select(F.col("pid").alias("row_id"), "split", F.explode(T.tokenize("note")).alias("term"))


def _tfidf(enc):
    t = _terms(enc)
    return FE.tfidf_transform(t.select("row_id", "term"), FE.tfidf_fit(t.where("split = 'train'").select("row_id", "term"), 2))


@query("tx25_tfidf", f"WITH {TFIDF} SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS w FROM tf", "enc")
def _(enc):
    return R6(_tfidf(enc), "w")


@query("tx26_char_ngrams", f"WITH tk AS (SELECT DISTINCT ' ' || tok || ' ' AS w FROM (SELECT unnest({_t}) AS tok FROM enc)), g AS (SELECT w, substr(w, i, n) AS term FROM (SELECT w, n, unnest(range(1, greatest(length(w) - n + 2, 1))) AS i FROM (SELECT w, unnest([3, 4, 5]) AS n FROM tk)) ) SELECT term, count(*) AS n FROM g WHERE length(term) >= 3 GROUP BY term", "enc")
def _(enc):
    tok = enc.select(F.explode(T.tokenize("note")).alias("tok")).distinct()
    return tok.select(F.explode(T.char_ngrams("tok")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("tx27_svd", None, "enc")
def _(enc):
    s, _ = FE.svd_fit(_tfidf(enc), 5)
    return enc.sparkSession.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate(s)], "k int, singular double")


@query("tx29_reference_codes", "WITH c AS (SELECT DISTINCT chr((65 + o_orderkey % 26)::INT) || lpad((o_orderkey * 7 % 100)::VARCHAR, 2, '0') AS code FROM orders) SELECT code FROM c WHERE NOT regexp_matches(code, '^[V-Y]') AND code NOT IN ('A00', 'B07')", "orders")
def _(orders):
    code = F.concat(F.chr((65 + F.col("o_orderkey") % 26).cast("int")), F.lpad((F.col("o_orderkey") * 7 % 100).cast("string"), 2, "0"), F.lit(".9"))
    return FE.reference_codes(orders.select(code.alias("code")), "code", exclude=("A00", "B07"))


@query("tx31_encode_ids", f"WITH f AS (SELECT token, count(*) AS freq FROM (SELECT unnest({_t}) AS token FROM enc WHERE split = 'train' AND pid % 3 > 0) GROUP BY token), v AS (SELECT token, row_number() OVER (ORDER BY freq DESC, token) + 3 AS id FROM f WHERE freq >= 2), p AS (SELECT pid, unnest({_t}) AS token, generate_subscripts({_t}, 1) AS i FROM enc) SELECT pid, string_agg(coalesce(id, 3)::VARCHAR, ',' ORDER BY i) AS ids FROM p LEFT JOIN v USING (token) GROUP BY pid", "enc")
def _(enc):
    v = VO.build_vocab(VO.token_freq(enc.where("split = 'train' and pid % 3 > 0"), T.tokenize("note")), 2)
    out = VO.encode_ids(enc, "pid", T.tokenize("note"), v)
    return out.select("pid", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


KNN = r"""d AS (SELECT * FROM (SELECT DISTINCT doc_id AS row_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term FROM documents) WHERE term <> ''),
n AS (SELECT count(DISTINCT row_id) AS n FROM d WHERE row_id % 5 > 0), idf AS (SELECT term, ln((1 + any_value(n)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM d, n WHERE row_id % 5 > 0 GROUP BY term HAVING count(*) >= 2),
w AS (SELECT row_id, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY row_id)) AS w FROM d JOIN idf USING (term)),
s AS (SELECT q.row_id AS qid, r.row_id AS rid, round(sum(q.w * r.w), 9) AS s FROM w q JOIN w r USING (term) WHERE q.row_id % 5 = 0 AND r.row_id % 5 > 0 GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) AS rank FROM s WHERE s > 0) WHERE rank <= 5)"""


@query("jn19_bl06_knn_vote", f"WITH {KNN} SELECT qid AS row_id, 'q' || quality AS label, count(*) AS votes FROM top JOIN labels ON doc_id = rid GROUP BY 1, 2 HAVING count(*) >= 2", "documents", "labels")
def _(docs, labels):
    d = docs.select(F.col("doc_id").alias("id"), "text")
    g = labels.select(F.col("doc_id").alias("row_id"), F.concat(F.lit("q"), "quality").alias("label"))
    return A.label_vote(A.texts_topk(d, F.split(F.lower("text"), r"[^\p{L}]+"), F.expr("id % 5 > 0"), F.expr("id % 5 = 0"), 5, 2), g)


@query("jn20_match_predictions", "WITH g AS (SELECT DISTINCT row_id, label FROM gold), h AS (SELECT DISTINCT row_id, label FROM pred WHERE p >= 0.5) SELECT pid AS row_id, (SELECT count(*) FROM g JOIN h USING (row_id, label) WHERE g.row_id = enc.pid) AS hits FROM enc", "gold", "pred", "enc")
def _(gold, pred, enc):
    return EV.row_counts(gold, pred.where("p >= 0.5"), enc.select(F.col("pid").alias("row_id"))).select("row_id", F.col("tp").alias("hits"))


@query("pf23_protocol_rows", "SELECT pid FROM enc WHERE note <> '' AND pid IN (SELECT row_id FROM gold WHERE label IN ('c1', 'c2', 'c3'))", "enc", "gold")
def _(enc, gold):
    return A.semi(enc.where("note <> ''").select("pid"), gold.where(F.col("label").isin("c1", "c2", "c3")).select(F.col("row_id").alias("pid")), "pid")


# ---- more aggregations over text


@query("ag21_drug_category", "WITH d AS (SELECT DISTINCT drug FROM rx), j AS (SELECT drug, CASE WHEN p_size > 5 THEN p_type END AS cat FROM d LEFT JOIN part ON p_partkey = drug) SELECT coalesce(cat, '<unmapped>') AS category, count(*) AS n FROM j GROUP BY 1", "rx", "part")
def _(rx, part):
    m = part.where("p_size > 5").select(F.col("p_partkey").alias("drug"), F.col("p_type").alias("category"))
    return A.map_join(rx.select("drug").distinct(), m, "drug").groupBy(F.coalesce("category", F.lit("<unmapped>")).alias("category")).agg(F.count("*").alias("n"))


@query("ag37_dispersion", f"WITH t AS (SELECT DISTINCT pid, unnest({_t}) AS token FROM enc), n AS (SELECT count(*) AS n FROM enc) SELECT token, count(*) AS df, round(ln(any_value(n)::DOUBLE / count(*)), 6) AS idf FROM t, n WHERE token IN ('dm', 'htn', 'lbp', 'sob', 'rt', 'right', 'hypertension', 'pain') GROUP BY token", "enc")
def _(enc):
    t = enc.select("pid", F.explode(F.array_distinct(T.tokenize("note"))).alias("token")).where(F.col("token").isin("dm", "htn", "lbp", "sob", "rt", "right", "hypertension", "pain"))
    n = enc.agg(F.count("*").alias("n"))
    return t.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


@query("ag38_complaint_structure", f"WITH {SPANS} SELECT len(s)::INT AS n_spans, count(*) AS n FROM enc JOIN sl USING (note) GROUP BY 1", "enc")
def _(enc):
    return enc.groupBy(F.size(T.segment("note")).alias("n_spans")).agg(F.count("*").alias("n"))


@query("ag39_oov", f"WITH v AS (SELECT DISTINCT unnest({_t}) AS token FROM enc WHERE split = 'train' AND pid % 24 < 20), t AS (SELECT unnest({_t}) AS token FROM enc WHERE split = 'test') SELECT count(*) AS tokens, count_if(token NOT IN (SELECT token FROM v)) AS oov_tokens, count(DISTINCT token) AS types, count(DISTINCT CASE WHEN token NOT IN (SELECT token FROM v) THEN token END) AS oov_types FROM t", "enc")
def _(enc):
    v = enc.where("split = 'train' and pid % 24 < 20").select(F.explode(T.tokenize("note")).alias("token")).distinct().withColumn("__k", F.lit(1))
    t = enc.where("split = 'test'").select(F.explode(T.tokenize("note")).alias("token")).join(v, "token", "left")
    new = F.col("__k").isNull()
    return t.agg(F.count("*").alias("tokens"), F.count_if(new).alias("oov_tokens"), F.countDistinct("token").alias("types"), F.countDistinct(F.when(new, F.col("token"))).alias("oov_types"))


@query("ag40_recoverable_oov", f"WITH {VOCAB}, o AS (SELECT token, b FROM tk WHERE token NOT IN (SELECT word FROM v)) SELECT count(*) AS oov, count_if(EXISTS (SELECT 1 FROM v WHERE left(word, 1) = left(token, 1) AND abs(length(word) - length(token)) <= b AND levenshtein(word, token) <= b AND b > 0)) AS recoverable FROM o", "enc")
def _(enc):
    v = _vocab(enc)
    o = v.select(F.concat(F.left("word", F.lit(2)), F.substring("word", 4, 99)).alias("token")).distinct().join(v, F.col("token") == v["word"], "left_anti")
    hit = A.fuzzy_token_join(o, v, _budget("token")).select("token").distinct().withColumn("__h", F.lit(1))
    return o.join(hit, "token", "left").agg(F.count("*").alias("oov"), F.count("__h").alias("recoverable"))


# ---- drug normalisation


def _drugs(rx, part):
    r = rx.join(part.select(F.col("p_partkey").alias("drug"), "p_name"), "drug", "left")
    return DN.drug_rollup(r, "drug", "p_name", "pid")


ROLL = "dr AS (SELECT drug, any_value(p_name) AS drug_name, count(*) AS n_orders, lower(any_value(p_name)) AS key FROM rx LEFT JOIN part ON p_partkey = drug GROUP BY drug)"


@query("dn01_drug_rollup", f"WITH {ROLL} SELECT * FROM dr", "rx", "part")
def _(rx, part):
    return _drugs(rx, part)


@query("dn02_dup_report", f"WITH {ROLL}, k AS (SELECT key, count(DISTINCT drug) AS ids FROM dr GROUP BY key) SELECT count_if(key <> '') AS n_names, count_if(key <> '' AND ids > 1) AS dup_names, coalesce(sum(ids - 1) FILTER (key <> '' AND ids > 1), 0)::BIGINT AS redundant_ids, coalesce(sum(ids) FILTER (key = ''), 0)::BIGINT AS unnamed_ids FROM k", "rx", "part")
def _(rx, part):
    return DN.dup_report(_drugs(rx, part), "drug")


CASCADE = f"""{ROLL}, cat AS (SELECT dr.*, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN 'ODD ' ELSE '' END AS category FROM dr LEFT JOIN part ON p_partkey = drug),
cur AS (SELECT lower(p_name) AS key, min(p_brand) AS molecule, 'class_' || left(lower(p_name), 1) AS drug_class FROM part WHERE p_name LIKE 'red%' GROUP BY p_name),
fold AS (SELECT lower(p_type) AS c, NULL::VARCHAR AS molecule, 'fold_' || lower(p_type) AS drug_class FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'ECONOMY')),
f1 AS (SELECT cat.*, CASE WHEN cur.drug_class IS NOT NULL THEN cur.molecule ELSE fold.molecule END AS m, coalesce(cur.drug_class, fold.drug_class) AS c1, CASE WHEN cur.drug_class IS NOT NULL THEN 'curated' WHEN fold.drug_class IS NOT NULL THEN 'rx_category' ELSE 'unmapped' END AS s FROM cat LEFT JOIN cur USING (key) LEFT JOIN fold ON fold.c = lower(trim(category))),
kn AS (SELECT key, m AS m3, c1 AS c3 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_orders DESC, drug) AS r FROM f1 WHERE c1 IS NOT NULL AND key <> '') WHERE r = 1),
res AS (SELECT drug, drug_name, key, n_orders, category, CASE WHEN c1 IS NULL AND c3 IS NOT NULL THEN m3 ELSE m END AS molecule, coalesce(c1, c3) AS drug_class, CASE WHEN c1 IS NULL AND c3 IS NOT NULL THEN 'name_fold' ELSE s END AS source FROM f1 LEFT JOIN kn USING (key))"""


def _resolved(rx, part) -> DataFrame:
    k = F.col("p_partkey") % 3
    d = _drugs(rx, part).join(part.select(F.col("p_partkey").alias("drug"), F.when(k == 0, F.col("p_type")).when(k == 1, "ODD ").otherwise("").alias("category")), "drug", "left")
    cur = part.where("p_name like 'red%'").groupBy("p_name").agg(F.min("p_brand").alias("molecule")).select(F.lower("p_name").alias("key"), "molecule", F.concat(F.lit("class_"), F.left(F.lower("p_name"), F.lit(1))).alias("drug_class"))
    fold = part.where("p_type <> 'ECONOMY'").select("p_type").distinct().select(F.col("p_type").alias("category"), F.lit(None).cast("string").alias("molecule"), F.concat(F.lit("fold_"), F.lower("p_type")).alias("drug_class"))
    return DN.resolve_classes(d, cur, fold, "drug")


@query("dn03_resolve_classes", f"WITH {CASCADE} SELECT * FROM res", "rx", "part")
def _(rx, part):
    return _resolved(rx, part)


def _external(part):
    return part.select(F.lower("p_name").alias("key")).distinct().select("key", F.concat(F.lit("fold_"), F.when(F.length("key") % 2 == 0, "small").otherwise("other")).alias("drug_class"), (F.length("key") % 3 + 1).alias("confidence"))


EXT = "ext AS (SELECT DISTINCT lower(p_name) AS key, 'fold_' || CASE WHEN length(p_name) % 2 = 0 THEN 'small' ELSE 'other' END AS drug_class, length(p_name) % 3 + 1 AS confidence FROM part)"


@query("dn04_accept_external", f"WITH {CASCADE}, {EXT} SELECT drug, drug_name, key, n_orders, category, molecule, coalesce(res.drug_class, x.drug_class) AS drug_class, CASE WHEN res.drug_class IS NULL AND x.drug_class IS NOT NULL THEN 'external' ELSE source END AS source FROM res LEFT JOIN (SELECT * FROM ext WHERE confidence >= 2 AND drug_class = 'fold_small') x USING (key)", "rx", "part")
def _(rx, part):
    classes = part.where("p_type = 'SMALL'").select(F.lit("fold_small").alias("drug_class")).distinct()
    return DN.accept_external(_resolved(rx, part), _external(part), classes, 2)


@query("dn05_mapper_agreement", f"WITH {EXT}, cur AS (SELECT DISTINCT lower(p_name) AS key, CASE WHEN p_name LIKE 'red%' THEN 'fold_small' ELSE 'fold_other' END AS g FROM part) SELECT confidence, count(*) AS n, round(avg((g = drug_class)::INT), 6) AS agreement FROM ext JOIN cur USING (key) GROUP BY confidence", "part")
def _(part):
    cur = part.select(F.lower("p_name").alias("key"), F.when(F.col("p_name").like("red%"), "fold_small").otherwise("fold_other").alias("drug_class")).distinct()
    return R6(DN.mapper_agreement(cur, _external(part)), "agreement")


@query("dn06_coverage", f"WITH {CASCADE} SELECT source, count(*) AS n_drugs, sum(n_orders)::BIGINT AS n_orders, count(drug_class) AS with_class, count(molecule) AS with_molecule FROM res GROUP BY source", "rx", "part")
def _(rx, part):
    return DN.coverage(_resolved(rx, part))


@query("dn07_cross_era", "WITH x AS (SELECT CASE WHEN year <= 1996 THEN 'early' ELSE 'late' END AS era, drug::VARCHAR AS brand, CASE WHEN p_size > 5 AND NOT (year <= 1996 AND p_type = 'SMALL') THEN p_type END AS class FROM rx JOIN enc USING (pid) LEFT JOIN part ON p_partkey = drug WHERE year <= 1996 OR year >= 2000), u AS (SELECT 'brand' AS level, era, brand AS label FROM x UNION ALL SELECT 'class', era, class FROM x), n AS (SELECT level, label, count_if(era = 'early') AS a, count_if(era = 'late') AS b FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY a DESC, label NULLS FIRST) AS ra, row_number() OVER (PARTITION BY level ORDER BY b DESC, label NULLS FIRST) AS rb FROM n) SELECT level, count_if(label IS NOT NULL AND a > 0) AS v_early, count_if(label IS NOT NULL AND b > 0) AS v_late, round(count_if(label IS NOT NULL AND a > 0 AND b > 0)::DOUBLE / count_if(label IS NOT NULL AND (a > 0 OR b > 0)), 6) AS jaccard, round(sum(CASE WHEN label IS NOT NULL AND a = 0 THEN b ELSE 0 END)::DOUBLE / sum(b), 6) AS unseen, round(sum(CASE WHEN label IS NULL OR a = 0 THEN b ELSE 0 END)::DOUBLE / sum(b), 6) AS strict, count_if(ra <= 10 AND rb <= 10 AND a > 0 AND b > 0) AS top10_shared FROM r GROUP BY level", "rx", "enc", "part")
def _(rx, enc, part):
    x = rx.join(enc.select("pid", "year"), "pid").where("year <= 1996 or year >= 2000").join(part.select(F.col("p_partkey").alias("drug"), "p_type", "p_size"), "drug", "left")
    x = x.select(F.when(F.col("year") <= 1996, "early").otherwise("late").alias("era"), F.col("drug").alias("brand"), F.when((F.col("p_size") > 5) & ~((F.col("year") <= 1996) & (F.col("p_type") == "SMALL")), F.col("p_type")).alias("class"))
    return R6(DN.cross_era(x, {"brand": "brand", "class": "class"}, "era"), "jaccard", "unseen", "strict")


@query("dn08_tx08_unfolded", f"WITH {CASCADE} SELECT category, sum(n_orders)::BIGINT AS n_orders FROM cat WHERE category <> '' AND lower(trim(category)) NOT IN (SELECT c FROM fold) GROUP BY category", "rx", "part")
def _(rx, part):
    fold = part.where("p_type <> 'ECONOMY'").select(F.col("p_type").alias("category")).distinct()
    return DN.unfolded(_resolved(rx, part), fold)


# ---- features


@query("fe01_loo_encode", "WITH t AS (SELECT pid, CASE WHEN uid % 9 = 0 THEN NULL ELSE site END AS site, (split = 'train')::INT AS t, CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM enc), g AS (SELECT site, sum(t * y) AS s, sum(t) AS n FROM t WHERE site IS NOT NULL GROUP BY site), p AS (SELECT avg(y) AS p FROM t WHERE t = 1) SELECT pid, round((s - t * y + 20 * p) / (greatest(n - t, 0) + 20), 6) AS enc FROM t LEFT JOIN g USING (site), p", "enc")
def _(enc):
    d = enc.select("pid", F.when(F.col("uid") % 9 != 0, F.col("site")).alias("site"), (F.col("split") == "train").alias("t"), (F.col("status") == "F").cast("double").alias("y"))
    return R6(FE.loo_target_encode(d, "site", "y", F.col("t")).select("pid", "enc"), "enc")


@query("fe02_category_codes", "WITH l AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS c FROM (SELECT DISTINCT status FROM enc WHERE split = 'train' AND status <> 'P')) SELECT pid, coalesce(c, (SELECT count(*) FROM l)) AS code FROM enc LEFT JOIN l USING (status)", "enc")
def _(enc):
    return FE.category_codes(enc, "status", (F.col("split") == "train") & (F.col("status") != "P")).select("pid", "code")


@query("fe03_profiles", "WITH t AS (SELECT pid, prescriber, (split = 'train')::INT AS t, (status = 'F')::INT AS y1, (kind = '2-HIGH')::INT AS y2 FROM enc), g AS (SELECT prescriber, sum(t) AS n, sum(t * y1) AS s1, sum(t * y2) AS s2 FROM t GROUP BY prescriber), p AS (SELECT avg(y1) AS p1, avg(y2) AS p2 FROM t WHERE t = 1) SELECT pid, greatest(n - t, 0)::DOUBLE AS prescriber_volume, round((s1 - t * y1 + 20 * p1) / (greatest(n - t, 0) + 20), 6) AS prescriber_rate_y1, round((s2 - t * y2 + 20 * p2) / (greatest(n - t, 0) + 20), 6) AS prescriber_rate_y2 FROM t JOIN g USING (prescriber), p", "enc")
def _(enc):
    d = enc.select("pid", "prescriber", (F.col("split") == "train").alias("t"), (F.col("status") == "F").cast("double").alias("y1"), (F.col("kind") == "2-HIGH").cast("double").alias("y2"))
    return R6(FE.profile_features(d, "prescriber", ["y1", "y2"], F.col("t")).drop("prescriber", "t", "y1", "y2"), "prescriber_rate_y1", "prescriber_rate_y2")


_icd = "i AS (SELECT pid, split, CASE WHEN pid % 4 > 0 THEN CASE pid % 4 WHEN 1 THEN 'confident' WHEN 2 THEN 'low_confidence' ELSE 'no_complaint' END END AS tier, CASE WHEN pid % 4 = 1 THEN chr((65 + pid % 9)::INT) || lpad((uid % 60)::VARCHAR, 2, '0') END AS code, CASE WHEN pid % 4 > 0 THEN CASE WHEN pid % 3 = 0 THEN 'high' ELSE 'low' END END AS conf FROM enc)"


@query("fe04_icd_features", f"WITH {_icd}, t AS (SELECT code, row_number() OVER (ORDER BY count(*) DESC, code) AS r FROM i WHERE split = 'train' AND code IS NOT NULL GROUP BY code) SELECT pid, coalesce(tier, 'absent_from_table') AS tier, CASE conf WHEN 'high' THEN 3.0 WHEN 'low' THEN 1.0 END::DOUBLE AS confidence, (i.code IS NOT NULL)::INT AS has_code, coalesce((r <= 12)::INT, 0) AS top_code FROM i LEFT JOIN t USING (code)", "enc")
def _(enc):
    code = F.concat(F.chr((65 + F.col("pid") % 9).cast("int")), F.lpad((F.col("uid") % 60).cast("string"), 2, "0"))
    icd = enc.where("pid % 4 > 0").select("pid", F.when(F.col("pid") % 4 == 1, "confident").when(F.col("pid") % 4 == 2, "low_confidence").otherwise("no_complaint").alias("tier"), F.when(F.col("pid") % 4 == 1, code).alias("icd_final"), F.when(F.col("pid") % 3 == 0, "high").otherwise("low").alias("llm_confidence"))
    f = FE.icd_features(enc, icd, F.col("split") == "train")
    tiers = ("confident", "low_confidence", "no_complaint", "absent_from_table")
    one = F.coalesce(*(F.when(F.col(f"icd_tier_{t}") == 1, t) for t in tiers))
    top = sum((F.col(c) for c in f.columns if c.startswith("icd_code_")), F.lit(0))
    return f.select("pid", one.alias("tier"), F.col("icd_llm_confidence").alias("confidence"), F.col("icd_has_code").alias("has_code"), top.alias("top_code"))


@query("fe06_targets", "SELECT e.pid, " + ", ".join(f"max(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS {t.lower()}" for t in ("SMALL", "LARGE")) + ", max(CASE WHEN r.pid IS NOT NULL AND (p_size IS NULL OR p_size <= 5) THEN 1 ELSE 0 END) AS unclassified, max(CASE WHEN qty >= 40 THEN 1 ELSE 0 END) AS chronic FROM enc e LEFT JOIN rx r ON r.pid = e.pid LEFT JOIN part ON p_partkey = drug GROUP BY e.pid", "enc", "rx", "part")
def _(enc, rx, part):
    j = rx.join(part.select(F.col("p_partkey").alias("drug"), "p_type", "p_size"), "drug", "left")
    lab = j.select("pid", F.lower("p_type").alias("label")).unionByName(j.where("p_size is null or p_size <= 5").select("pid", F.lit("unclassified").alias("label"))).unionByName(j.where("qty >= 40").select("pid", F.lit("chronic").alias("label")))
    return VO.multi_hot(enc, lab, "pid", "label", ["small", "large", "unclassified", "chronic"])


@query("fe09_numeric_block", "WITH m AS (SELECT quantile_cont(price, 0.5) AS mp, quantile_cont(age, 0.5) AS ma FROM enc WHERE split = 'train'), x AS (SELECT pid, split, coalesce(price, mp) AS price, coalesce(age, ma) AS age FROM enc, m), s AS (SELECT avg(price) AS ap, stddev_pop(price) AS sp, avg(age) AS aa, stddev_pop(age) AS sa FROM x WHERE split = 'train') SELECT pid, round((price - ap) / sp, 5) AS price, round((age - aa) / sa, 5) AS age FROM x, s", "enc")
def _(enc):
    b = FE.numeric_block(enc.select("pid", "split", "price", "age"), ["price", "age"], F.col("split") == "train")
    return b.select("pid", F.round("price", 5).alias("price"), F.round("age", 5).alias("age"))


@query("fe10_onehot_block", "SELECT pid, (coalesce(kind, '') = '1-URGENT')::INT AS kind_0, (coalesce(kind, '') = '2-HIGH')::INT AS kind_1, (coalesce(kind, '') = '3-MEDIUM')::INT AS kind_2 FROM enc", "enc")
def _(enc):
    levels = FE.train_levels(enc, "kind", (F.col("split") == "train") & (F.col("kind") <= "3-MEDIUM"))
    return FE.onehot_block(enc.select("pid", "kind"), "kind", levels).drop("kind")


def _grams():
    """Character n-grams of the words of a text."""
    return F.flatten(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: T.char_ngrams(w)))


_words = "SELECT {k} AS row_id, ' ' || unnest(regexp_extract_all(lower(text), '[a-z]+')) || ' ' AS w FROM {t}"
_gr = "SELECT row_id, substr(w, i, n) AS term FROM (SELECT row_id, w, n, unnest(range(1, greatest(length(w) - n + 2, 1))) AS i FROM (SELECT row_id, w, unnest([3, 4, 5]) AS n FROM ({})))"
_wt = "SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS w FROM (SELECT row_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM {} JOIN idf USING (term) GROUP BY 1, 2)"
HYBRID = f"""cv AS (SELECT conv_id * 1000 + turn AS qid, text FROM conversations), rg AS ({_gr.format(_words.format(k='item_id', t='benchmark'))}), qg AS ({_gr.format(_words.format(k='qid', t='cv'))}),
nn AS (SELECT count(DISTINCT row_id) AS n FROM rg), idf AS (SELECT term, ln((1 + any_value(n)) / (1.0::DOUBLE + count(DISTINCT row_id))) + 1 AS idf FROM rg, nn GROUP BY term),
rw AS ({_wt.format('rg')}), qw AS ({_wt.format('qg')}), lex AS (SELECT q.row_id AS qid, r.row_id AS rid, sum(q.w * r.w) AS s FROM qw q JOIN rw r USING (term) GROUP BY 1, 2),
sem AS (SELECT qid, item_id AS rid, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS s FROM cv LEFT JOIN embeddings a ON a.vec_id = qid // 1000 CROSS JOIN benchmark LEFT JOIN embeddings b ON b.vec_id = item_id),
hy AS (SELECT qid, rid, rank, score FROM (SELECT qid, rid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM (SELECT qid, rid, round(0.5 * sem.s + 0.5 * coalesce(lex.s, 0), 9) AS score FROM sem LEFT JOIN lex USING (qid, rid))) WHERE rank <= 5)"""


def _hybrid(cv, bench, em):
    """Turns of conversations against reference texts; embeddings stand in for their vectors."""
    q, r = cv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text"), bench.select(F.col("item_id").alias("rid"), "text")
    side = lambda d, key: d.join(em.select("vec_id", F.col("embedding").alias("vec")), F.expr(key) == F.col("vec_id"), "left").drop("vec_id")
    return A.text_topk(side(q, "qid div 1000"), side(r, "rid"), _grams())


@query("fe15_hybrid_topk", f"WITH {HYBRID} SELECT qid, rid, rank, round(score, 6) AS score FROM hy", "conversations", "benchmark", "embeddings")
def _(cv, bench, em):
    return R6(_hybrid(cv, bench, em), "score")


@query("fe16_fe17_final_codes", f"WITH {HYBRID}, b AS (SELECT qid, list(rid ORDER BY rank) AS cand, max(score) AS s FROM hy GROUP BY qid), t AS (SELECT qid, cand, s, [(qid * 7) % 41, (qid * 3) % 40, cand[2]] AS codes, CASE WHEN length(text) < 40 THEN 'no_complaint' WHEN s >= 0.5 THEN 'confident' ELSE 'low_confidence' END AS tier FROM b JOIN cv USING (qid)), u AS (SELECT *, list_filter(CASE WHEN qid % 3 > 0 THEN codes ELSE [] END, lambda x: list_contains(cand, x)) AS ok FROM t) SELECT qid, tier, CASE WHEN len(ok) > 0 THEN ok[1] WHEN tier = 'confident' THEN cand[1] END AS final FROM u", "conversations", "benchmark", "embeddings")
def _(cv, bench, em):
    """Tiers by the best hybrid score, and an adjudicator's codes (a stand-in table) over the candidates."""
    c = _hybrid(cv, bench, em).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rid"))), lambda x: x["rid"]).alias("cand"), F.max("score").alias("s"))
    t = c.join(cv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.length("text").alias("n")), "qid")
    codes = F.when(F.col("qid") % 3 > 0, F.array(F.col("qid") * 7 % 41, F.col("qid") * 3 % 40, F.get("cand", F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("tier", FE.tier(F.col("s"), F.col("n") < 40))
    return t.select("qid", "tier", FE.finalise(codes, F.col("cand"), F.get("cand", F.lit(0)), F.col("tier")).alias("final"))


@query("fe18_mutual_information", "WITH e AS (SELECT quantile_cont(price, [" + ", ".join(str(k / 16) for k in range(1, 16)) + "]) AS e FROM enc), b AS (SELECT status AS y, CASE WHEN price IS NULL THEN 17 ELSE len(list_filter(list_distinct(e), lambda x: x <= price)) END AS b FROM enc, e), n AS (SELECT b, y, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS nn FROM n) SELECT 'price' AS feature, round(sum(n / nn * ln(n * nn / (nb * ny))), 6) AS mi FROM t", "enc")
def _(enc):
    return R6(FE.mutual_information(enc.select("status", "price"), ["price"], "status"), "mi")


@query("ag43_icd_tiers", "SELECT CASE WHEN length(text) < 40 THEN 'no_complaint' WHEN (length(text) % 100) / 100.0 >= 0.5 THEN 'confident' ELSE 'low_confidence' END AS tier, count(*) AS n FROM documents GROUP BY 1", "documents")
def _(docs):
    n = F.length("text")
    t = docs.select(FE.tier((n % 100) / 100.0, n < 40).alias("tier"))
    return t.groupBy("tier").agg(F.count("*").alias("n"))


@query("ag46_output_audit", "SELECT role, count(*) AS n, round(avg((length(text) < 20)::INT), 6) AS failed, round(avg(len(regexp_extract_all(text, '\\.'))), 6) AS mean_size FROM conversations GROUP BY role", "conversations")
def _(cv):
    return R6(cv.groupBy("role").agg(F.count("*").alias("n"), F.avg((F.length("text") < 20).cast("double")).alias("failed"), F.avg(F.regexp_count("text", F.lit(r"\."))).alias("mean_size")), "failed", "mean_size")


# ---- annotation study


@query("an01_vitals_block", "SELECT pid, concat_ws('; ', 'Age ' || printf('%.1f', age) || ' y', 'Price ' || printf('%.1f', floor(price)) || ' u') AS vitals FROM enc", "enc")
def _(enc):
    v = AN.vitals_block({"age": ("Age", "y"), "price": ("Price", "u")})
    return enc.withColumn("price", F.floor("price")).select("pid", F.array_join(F.transform(v, lambda x: F.concat_ws(" ", x["label"], x["value"], x["unit"])), "; ").alias("vitals"))


@query("an02_rx_lines", "SELECT pid, string_agg(line::VARCHAR || ':' || drug::VARCHAR || ':' || form, ',' ORDER BY line, drug, form) AS lines FROM rx GROUP BY pid", "rx")
def _(rx):
    r = AN.rx_lines(rx, "pid", "line", ["drug", "form"])
    return r.select("pid", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["line"].cast("string"), x["drug"].cast("string"), x["form"])), ",").alias("lines"))


_coin = "('0x' || substr(md5(concat_ws(':', '13', pid::VARCHAR)), 1, 8))::BIGINT % 2 = 0"


STUDY = "stu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ('0x' || substr(md5(concat_ws(':', '42', pid::VARCHAR)), 1, 8))::BIGINT, pid) AS r FROM enc) WHERE r <= 200)"


def _items(enc):
    """The items of an annotation study: a stratified sample (TK-5)."""
    from ..operators.sample import stratified_sample

    return stratified_sample(enc, "kind", "pid", {}, 200, 42)


def _study(enc):
    p = _items(enc).select("pid", F.concat(F.lit("m"), F.col("pid").cast("string")).alias("model"), F.concat(F.lit("h"), F.col("pid").cast("string")).alias("historical"))
    return AN.blind_pairs(p, "pid", 13)


@query("an03_an05_blinding", f"WITH {STUDY} SELECT md5('13:' || pid::VARCHAR) AS ann_id, CASE WHEN {_coin} THEN 'm' ELSE 'h' END || pid::VARCHAR AS option1, CASE WHEN {_coin} THEN 'model' ELSE 'historical' END AS option1_is FROM stu", "enc")
def _(enc):
    packet, truth = _study(enc)
    return packet.join(truth, "ann_id").select("ann_id", "option1", "option1_is")


@query("an04_assign", f"WITH {STUDY}, r AS (SELECT pid, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', '4', pid::VARCHAR)), 1, 8))::BIGINT, pid) AS r, floor(count(*) OVER () * 0.2) AS n FROM stu) SELECT pid, unnest(CASE WHEN r <= n THEN [0, 1, 2] ELSE [((r - n - 1) % 3)::INT] END) AS annotator FROM r", "enc")
def _(enc):
    return AN.assign(_items(enc), "pid", 3, 0.2, 4)


def _answers(enc):
    a = _items(enc).select(F.md5(F.concat(F.lit("13:"), F.col("pid").cast("string"))).alias("ann_id"), "pid", F.expr("CASE CAST(uid % 4 AS INT) WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'equal' ELSE '1' END").alias("preference"), F.expr("CASE WHEN uid % 3 = 0 THEN 'unsafe' WHEN uid % 3 = 1 THEN 'appropriate' END").alias("safety1"), F.expr("CASE WHEN uid % 5 = 0 THEN 'unsafe' ELSE 'suboptimal' END").alias("safety2"))
    return AN.unblind(a.drop("pid"), _study(enc)[1])


ANS = f"{STUDY}, ans AS (SELECT pid, CASE uid % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'equal' ELSE '1' END AS preference, CASE WHEN uid % 3 = 0 THEN 'unsafe' WHEN uid % 3 = 1 THEN 'appropriate' END AS safety1, CASE WHEN uid % 5 = 0 THEN 'unsafe' ELSE 'suboptimal' END AS safety2, CASE WHEN {_coin} THEN 'model' ELSE 'historical' END AS o1, CASE WHEN {_coin} THEN 'historical' ELSE 'model' END AS o2 FROM stu), un AS (SELECT *, CASE preference WHEN '1' THEN o1 WHEN '2' THEN o2 ELSE preference END AS winner FROM ans)"
_wl = "({k}::DOUBLE / {n} + 1.96 * 1.96 / (2 * {n}) {s} 1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 1.96 * 1.96 / (4.0::DOUBLE * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})"


@query("jn23_an07_preference", f"WITH {ANS}, c AS (SELECT count_if(winner = 'model') AS model, count_if(winner = 'historical') AS historical, count_if(winner = 'equal') AS equal, count_if(winner = 'both_bad') AS both_bad FROM un) SELECT *, round(model::DOUBLE / (model + historical), 6) AS win_rate, round({_wl.format(k='model', n='(model + historical)', s='-')}, 6) AS lo, round({_wl.format(k='model', n='(model + historical)', s='+')}, 6) AS hi, {_wl.format(k='model', n='(model + historical)', s='-')} > 0.4 AS non_inferior FROM c", "enc")
def _(enc):
    return R6(AN.preference(_answers(enc)), "win_rate", "lo", "hi")


@query("an08_an09_safety", f"WITH {ANS}, l AS (SELECT o1 AS source, safety1 AS s FROM un UNION ALL SELECT o2, safety2 FROM un), c AS (SELECT source, count(*) AS n, count_if(s = 'unsafe') AS unsafe FROM l WHERE s IS NOT NULL GROUP BY source) SELECT source, n, unsafe, round({_wl.format(k='unsafe', n='n', s='-')}, 6) AS lo, round({_wl.format(k='unsafe', n='n', s='+')}, 6) AS hi FROM c", "enc")
def _(enc):
    return R6(AN.safety(_answers(enc)), "lo", "hi")


@query("an06_icd_accuracy", "SELECT kind, count(*) AS n, round(avg((status = left(kind, 1))::INT) FILTER (uid % 3 > 0), 6) AS exact, round(avg((left(status, 1) = left(kind, 1))::INT) FILTER (uid % 3 > 0), 6) AS chapter, round(avg((uid % 3 > 0)::INT), 6) AS codable FROM enc GROUP BY kind", "enc")
def _(enc):
    a = enc.select("kind", F.when(F.col("uid") % 3 > 0, F.col("status")).alias("code"), F.left("kind", F.lit(1)).alias("model"))
    return R6(AN.icd_accuracy(a, "kind"), "exact", "chapter", "codable")


@query("an10_kappa", "WITH j AS (SELECT upper(status) AS x, upper(CASE WHEN uid % 3 = 0 THEN 'F' ELSE status END) AS y FROM enc), m AS (SELECT sum(nx * ny)::DOUBLE AS pe FROM (SELECT x AS v, count(*) AS nx FROM j GROUP BY x) JOIN (SELECT y AS v, count(*) AS ny FROM j GROUP BY y) USING (v)), s AS (SELECT count(*) AS n, avg((x = y)::INT) AS po FROM j) SELECT n, round(po, 6) AS agreement, round((po - pe / (n::DOUBLE * n)) / (1 - pe / (n::DOUBLE * n)), 6) AS kappa FROM s, m", "enc")
def _(enc):
    a = enc.select("pid", "status")
    b = enc.select("pid", F.when(F.col("uid") % 3 == 0, "F").otherwise(F.col("status")).alias("status"))
    return R6(AN.kappa(a, b, "pid", "status"), "agreement", "kappa")


# ---- models, streaming, artefacts


def _features(enc: DataFrame) -> DataFrame:
    from ..operators.models import feature_set

    b = FE.numeric_block(enc.select(F.col("pid").alias("row_id"), "split", "price", "age", (F.col("sex") == "M").cast("double").alias("male"), F.length("note").cast("double").alias("chars")), ["price", "age", "male", "chars"], F.col("split") == "train")
    return feature_set("text+physio", {"text": ["chars"], "physio": ["price", "age", "male"]}).fit(b).transform(b)


@query("ml01_ml02_ovr", None, "enc")
def _(enc):
    from ..operators.models import fit_ovr, multiclass, score_ovr

    x = _features(enc)
    gold = enc.select(F.col("pid").alias("row_id"), F.col("status").alias("label"))
    m = fit_ovr(x.where("split = 'train'"), gold, ["F", "O", "P", "none"])
    return multiclass(score_ovr(m, x.where("split = 'test'")))


@query("ml03_ml04_counts", None, "enc", "rx")
def _(enc, rx):
    from ..operators.models import boosted, count_model, predict_counts

    x = _features(enc).join(VO.count_targets(enc, {"n": rx}, "pid").withColumnRenamed("pid", "row_id"), "row_id").withColumns({"n": F.col("n").cast("double"), "any": (F.col("n") > 4).cast("double")})
    train, test = x.where("split = 'train'"), x.where("split = 'test'")
    ridge = predict_counts(count_model(train, "n"), test).select("row_id", F.col("prediction").alias("ridge"))
    median = predict_counts(count_model(train, "n", "lad", 0.0), test).select("row_id", F.col("prediction").alias("median"))
    pois = boosted(train, "n", "poisson", trees=6, depth=3).transform(test).select("row_id", F.col("prediction").alias("poisson"))
    tree = boosted(train, "any", trees=3).transform(test).select("row_id", F.col("prediction").alias("boosted"))
    return ridge.join(median, "row_id").join(pois, "row_id").join(tree, "row_id")


@query("ml05_ml07_fit_component", None, "enc")
def _(enc):
    from ..operators.models import fit_component

    b = FE.numeric_block(enc.select(F.col("pid").alias("row_id"), "split", "price", "age", F.length("note").cast("double").alias("chars")), ["price", "age", "chars"], F.col("split") == "train")
    gold = enc.select(F.col("pid").alias("row_id"), F.col("status").alias("label"))
    return fit_component(b, gold, ["F", "O"], {"text": ["chars"], "physio": ["price", "age"]}, ["text", "text+physio"], [1.0])


@query("ev19_permutation", None, "bin")
def _(b):
    from ..operators.models import permutation_importance

    score = lambda d: EV.auroc(d, []).select(F.col("auroc").alias("score"))
    return permutation_importance(b.select("row_id", "y", "p", "p2"), {"p": ["p"], "p2": ["p2"]}, score)


@query("st02_intake", f"WITH {TYPED}, v AS (SELECT *, {_seen} AS n_measured FROM vit) SELECT raw.pid, v.sex, v.blood_glucose, round(v.temperature, 4) AS temperature, n_measured FROM raw JOIN v ON v.pid::VARCHAR = raw.pid", "raw")
def _(raw):
    from ..streaming.online import stream_clean

    return stream_clean(raw).select("pid", "sex", "blood_glucose", F.round("temperature", 4).alias("temperature"), "n_measured")


@query("io04_pruned_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'", "orders")
def _(o):
    return o.where("o_orderdate >= timestamp '2001-01-01'").select("o_orderkey", "o_totalprice")


def _stream_decide(spark, sf_dir: str) -> DataFrame:
    """The decision of ab07 on a stream of encounters: a model and the frozen policy inside the stream, written once and
    read back."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from ..sources.scratch import scratch
    from ..streaming.online import serve
    from .base import STANDINS
    from .q_score import _comp, _policy

    out = scratch(spark)
    path = f"{sf_dir}/orders.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        stream = reader.option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    else:
        stream = reader.parquet(path)
    b = stream.selectExpr(*(f"{e} AS `{c}`" for c, e in STANDINS["bin"][1].items()))
    model = PipelineModel([SQLTransformer(statement=f"SELECT row_id, {_comp} AS component, p AS confidence, grp < 2 AS sparse FROM __THIS__")])
    _policy(b).write.parquet(f"{out}/policy")
    serve(b, model, f"{out}/policy", f"{out}/rows", f"{out}/log", ["row_id", "component", "cover"], "sparse")
    return spark.read.parquet(f"{out}/rows").select("row_id", "component", "cover")


QUERIES["st01_stream_decide"] = _stream_decide
ORACLE_SQL["st01_stream_decide"] = ORACLE_SQL["ab07_decide"]
