"""Queries over cleaning, classification and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.constants import ICD_CHAPTERS, VITAL_RANGES
from .base import query

V = list(VITAL_RANGES)
_num = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in V)
TYPED = f"""typed AS (SELECT TRY_CAST(pid AS BIGINT) AS pid, {_num}, TRY_CAST(visit AS TIMESTAMP) AS visit, TRY_CAST(born AS TIMESTAMP) AS born,
  CASE WHEN substr(upper(trim(sex)), 1, 1) IN ('M', 'F') THEN substr(upper(trim(sex)), 1, 1) END AS sex, upper(trim(coalesce(glucose_type, 'NA'))) AS glucose_type FROM raw),
fixed AS (SELECT * REPLACE (CASE WHEN blood_glucose <= 20 THEN blood_glucose * 18.0 ELSE blood_glucose END AS blood_glucose,
  CASE WHEN temperature BETWEEN 30 AND 45 THEN temperature * 9 / 5 + 32 ELSE temperature END AS temperature) FROM typed),
vit AS (SELECT * REPLACE ({", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in VITAL_RANGES.items())}) FROM fixed)"""


def typed(raw):
    df = raw.select(F.col("pid").try_cast("bigint").alias("pid"), *(C.num(c).alias(c) for c in V), C.ts("visit").alias("visit"), C.ts("born").alias("born"), C.norm_sex("sex").alias("sex"), C.default_na("glucose_type", True).alias("glucose_type"))
    return df.withColumns({"blood_glucose": C.harmonise_glucose("blood_glucose"), "temperature": C.harmonise_temperature("temperature")})


def vitals(raw):
    return C.clip_ranges(typed(raw))


@query("pf01_pf02_coercion", f"WITH {TYPED} SELECT pid, height, visit, born FROM typed", "raw")
def _(raw):
    return typed(raw).select("pid", "height", "visit", "born")


@query("pf03_clip_ranges", f"WITH {TYPED} SELECT pid, {', '.join(V)} FROM vit", "raw")
def _(raw):
    return vitals(raw).select("pid", *V)


@query("pf04_pf05_unit_repair", f"WITH {TYPED} SELECT pid, blood_glucose, round(temperature, 4) AS temperature FROM fixed", "raw")
def _(raw):
    return typed(raw).select("pid", "blood_glucose", F.round("temperature", 4).alias("temperature"))


@query("pf06_age_years", f"WITH {TYPED} SELECT pid, CASE WHEN year(visit) - year(born) BETWEEN 0 AND 110 THEN (year(visit) - year(born))::DOUBLE END AS age FROM typed", "raw")
def _(raw):
    return typed(raw).select("pid", C.age_years("visit", "born").alias("age"))


@query("pf07_pf08_flags", "SELECT pid, CASE WHEN substr(upper(trim(sex)), 1, 1) IN ('M','F') THEN substr(upper(trim(sex)), 1, 1) END AS sex, CASE WHEN lower(trim(smoker)) = 'yes' THEN 1 ELSE 0 END AS smoker_flag, upper(trim(coalesce(glucose_type, 'NA'))) AS glucose_type FROM raw", "raw")
def _(raw):
    return raw.select("pid", C.norm_sex("sex").alias("sex"), C.smoker_flag("smoker").alias("smoker_flag"), C.default_na("glucose_type", True).alias("glucose_type"))


@query("pf09_orders_with_drug", "SELECT count(*) AS n, sum(qty) AS qty FROM rx WHERE nullif(drug % 10, 0) IS NOT NULL", "rx")
def _(rx):
    return rx.where(F.nullif(F.col("drug") % 10, F.lit(0)).isNotNull()).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


_miss = ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS miss_{c}" for c in V)
_seen = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in V)


@query("pf10_missing_panel", f"WITH {TYPED} SELECT pid, {_miss}, {_seen} AS n_measured, ({_seen}) / {len(V)}.0 AS frac_measured FROM vit", "raw")
def _(raw):
    return C.missing_panel(vitals(raw).select("pid", *V), V).select("pid", *(f"miss_{c}" for c in V), "n_measured", "frac_measured")


@query("pf11_age_band", "SELECT pid, CASE WHEN age <= -1 THEN NULL WHEN age <= 17 THEN 0 WHEN age <= 29 THEN 1 WHEN age <= 39 THEN 2 WHEN age <= 49 THEN 3 WHEN age <= 59 THEN 4 WHEN age <= 69 THEN 5 WHEN age <= 200 THEN 6 END AS band FROM enc", "enc")
def _(enc):
    return enc.select("pid", C.age_band("age").alias("band"))


@query(
    "pf12_pf13_blood_pressure",
    f"""WITH {TYPED} SELECT pid, round(bp_dia + (bp_sys - bp_dia) / 3.0, 6) AS map, bp_sys - bp_dia AS pulse_pressure,
  CASE WHEN bp_sys IS NULL OR bp_dia IS NULL THEN NULL WHEN bp_sys >= 140 OR bp_dia >= 90 THEN 3 WHEN bp_sys >= 130 OR bp_dia >= 80 THEN 2 WHEN bp_sys >= 120 THEN 1 ELSE 0 END AS bp_cat,
  CASE WHEN bp_sys IS NULL OR bp_dia IS NULL THEN NULL WHEN bp_sys >= 140 OR bp_dia >= 90 THEN 1 ELSE 0 END AS hypertensive FROM vit""",
    "raw",
)
def _(raw):
    b = C.bp_derived("bp_sys", "bp_dia") | C.bp_category("bp_sys", "bp_dia")
    return vitals(raw).select("pid", F.round(b["map"], 6).alias("map"), b["pulse_pressure"].alias("pulse_pressure"), b["bp_cat"].alias("bp_cat"), b["hypertensive"].alias("hypertensive"))


@query(
    "pf14_pf16_anthropometry",
    f"""WITH {TYPED} SELECT pid, CASE WHEN bmi < 18.5 THEN 0 WHEN bmi < 23 THEN 1 WHEN bmi < 27.5 THEN 2 WHEN bmi >= 27.5 THEN 3 END AS bmi_cat, round(sqrt(height * weight / 3600.0), 6) AS bsa,
  CASE WHEN waist_hip_ratio IS NULL THEN NULL WHEN waist_hip_ratio > (CASE WHEN sex = 'M' THEN 0.90 ELSE 0.85 END) THEN 1 ELSE 0 END AS whr_risk FROM vit""",
    "raw",
)
def _(raw):
    return vitals(raw).select("pid", C.bmi_category_asian("bmi").alias("bmi_cat"), F.round(C.bsa("height", "weight"), 6).alias("bsa"), C.whr_risk("waist_hip_ratio", "sex").alias("whr_risk"))


@query(
    "pf17_glucose_category",
    f"""WITH {TYPED}, t AS (SELECT *, CASE WHEN glucose_type = 'FBS' THEN 126.0 ELSE 200.0 END AS hi, CASE WHEN glucose_type = 'FBS' THEN 100.0 ELSE 140.0 END AS mid FROM vit)
  SELECT pid, CASE WHEN blood_glucose IS NULL THEN NULL WHEN blood_glucose >= hi THEN 2 WHEN blood_glucose >= mid THEN 1 ELSE 0 END AS glucose_cat, round(blood_glucose / hi::DOUBLE, 6) AS glucose_ratio FROM t""",
    "raw",
)
def _(raw):
    g = C.glucose_category("blood_glucose", "glucose_type")
    return vitals(raw).select("pid", g["glucose_cat"].alias("glucose_cat"), F.round(g["glucose_ratio"], 6).alias("glucose_ratio"))


@query(
    "pf18_pf20_flags",
    f"""WITH {TYPED} SELECT pid, CASE WHEN blood_hemoglobin IS NULL THEN NULL WHEN blood_hemoglobin < (CASE WHEN sex = 'M' THEN 13 ELSE 12 END) THEN 1 ELSE 0 END AS anaemic,
  (CASE WHEN sex = 'M' THEN 13 ELSE 12 END) - blood_hemoglobin AS hb_deficit, CASE WHEN temperature IS NULL THEN NULL WHEN temperature >= 100.4 THEN 1 ELSE 0 END AS fever,
  CASE WHEN oxygen_of_blood IS NULL THEN NULL WHEN oxygen_of_blood < 94 THEN 1 ELSE 0 END AS hypoxic, CASE WHEN pulse_rate IS NULL THEN NULL WHEN pulse_rate > 100 THEN 1 ELSE 0 END AS tachycardic,
  CASE WHEN pulse_rate IS NULL THEN NULL WHEN pulse_rate < 60 THEN 1 ELSE 0 END AS bradycardic, CASE WHEN cholesterol IS NULL THEN NULL WHEN cholesterol >= 200 THEN 1 ELSE 0 END AS chol_high,
  CASE WHEN uric_acid IS NULL THEN NULL WHEN uric_acid > (CASE WHEN sex = 'M' THEN 7 ELSE 6 END) THEN 1 ELSE 0 END AS uric_high FROM vit""",
    "raw",
)
def _(raw):
    a = C.anaemia("blood_hemoglobin", "sex") | C.vital_flags() | {"uric_high": C.uric_high("uric_acid", "sex")}
    return vitals(raw).select("pid", *(v.alias(k) for k, v in a.items()))


_f = lambda test, c: f"CASE WHEN {c} IS NULL THEN NULL WHEN {test} THEN 1.0 ELSE 0.0 END"
NCD = f"""ncd AS (SELECT pid, sex,
  CASE WHEN bp_sys IS NULL AND bp_dia IS NULL THEN NULL WHEN coalesce(bp_sys >= 140, false) OR coalesce(bp_dia >= 90, false) THEN 1.0 ELSE 0.0 END AS hypertension_who,
  CASE WHEN bp_sys IS NULL AND bp_dia IS NULL THEN NULL WHEN coalesce(bp_sys >= 160, false) OR coalesce(bp_dia >= 100, false) THEN 1.0 ELSE 0.0 END AS hypertension_stage2,
  {_f("blood_glucose >= (CASE WHEN glucose_type LIKE 'FBS%' THEN 126 ELSE 200 END)", "blood_glucose")} AS diabetes_range,
  {_f("blood_glucose >= (CASE WHEN glucose_type LIKE 'FBS%' THEN 100 ELSE 140 END) AND blood_glucose < (CASE WHEN glucose_type LIKE 'FBS%' THEN 126 ELSE 200 END)", "blood_glucose")} AS prediabetes_range,
  {_f("bmi >= 23", "bmi")} AS overweight_asian, {_f("bmi >= 27.5", "bmi")} AS obese_asian, {_f("bmi >= 25", "bmi")} AS overweight_who, {_f("bmi >= 30", "bmi")} AS obese_who, {_f("bmi < 18.5", "bmi")} AS underweight,
  {_f("blood_hemoglobin < (CASE WHEN sex = 'M' THEN 13 ELSE 12 END)", "blood_hemoglobin")} AS anaemia_who, {_f("oxygen_of_blood < 94", "oxygen_of_blood")} AS hypoxaemia, {_f("pulse_rate > 100", "pulse_rate")} AS tachycardia FROM vit),
ncd2 AS (SELECT *, CASE WHEN coalesce(hypertension_who, diabetes_range, obese_asian) IS NOT NULL THEN coalesce(hypertension_who, 0) + coalesce(diabetes_range, 0) + coalesce(obese_asian, 0) END AS ncd_count FROM ncd)"""
FLAGS = ["hypertension_who", "hypertension_stage2", "diabetes_range", "prediabetes_range", "overweight_asian", "obese_asian", "overweight_who", "obese_who", "underweight", "anaemia_who", "hypoxaemia", "tachycardia"]


@query("pf21_ncd_flags", f"WITH {TYPED}, {NCD} SELECT pid, {', '.join(FLAGS)}, ncd_count, CASE WHEN ncd_count >= 2 THEN 1.0 ELSE 0.0 END AS ncd_multimorbid FROM ncd2", "raw")
def _(raw):
    return C.ncd_flags(vitals(raw)).select("pid", *FLAGS, "ncd_count", "ncd_multimorbid")


@query("ag27_prevalence", f"WITH {TYPED}, {NCD} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count({f}) AS measured, sum({f})::DOUBLE AS cases, avg({f}) AS rate FROM ncd2" for f in FLAGS), "raw")
def _(raw):
    from ..operators.profile import prevalence

    return prevalence(C.ncd_flags(vitals(raw)), FLAGS)


@query("pf22_raw_frame", f"WITH {TYPED} SELECT pid, {', '.join(V)}, {_miss}, {_seen} AS n_measured, coalesce(sex, 'NA') AS sex, glucose_type FROM vit", "raw")
def _(raw):
    v = C.missing_panel(vitals(raw), V)
    return v.select("pid", *V, *(f"miss_{c}" for c in V), "n_measured", C.default_na("sex").alias("sex"), "glucose_type")


@query("pf24_slug", "SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(p_name || ' -' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part", "part")
def _(part):
    return part.select("p_partkey", C.slug(F.concat("p_name", F.lit(" -"), "p_brand")).alias("slug"))


@query("pf27_text_checks", "SELECT lang, count(*) AS n, count_if(regexp_matches(text, '[ঀ-৿]')) AS bengali, count_if(regexp_matches(text, '[A-Za-z]')) AS latin, count_if(regexp_matches(text, '<[^>]+>')) AS html, count_if(regexp_matches(text, '&[a-z]+;')) AS entity FROM documents GROUP BY lang", "documents")
def _(docs):
    from ..operators.profile import text_checks

    return text_checks(docs, "text", "lang")


@query(
    "tx04_tx06_duration",
    """WITH q AS (SELECT pid, line, TRY_CAST(nullif(regexp_extract(qty::DECIMAL(10,1)::VARCHAR || ' days', '\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS v, trim(coalesce(unit, 'NA')) AS unit FROM rx),
  d AS (SELECT *, CASE WHEN v > 0 AND v <= 365 THEN v END AS qty_days FROM q),
  e AS (SELECT *, CASE unit WHEN 'Cont.' THEN 999.0 WHEN 'Days' THEN qty_days WHEN 'Weeks' THEN qty_days * 7 WHEN 'Month' THEN qty_days * 30 END AS days FROM d)
  SELECT pid, line, qty_days, days, CASE WHEN days IS NULL OR days <= 0 THEN 'NA' WHEN days <= 3 THEN '<=3d' WHEN days <= 7 THEN '4-7d' WHEN days <= 14 THEN '8-14d' WHEN days <= 30 THEN '15-30d' WHEN days <= 90 THEN '31-90d' WHEN days <= 1000 THEN '>90d/cont' ELSE 'NA' END AS bucket FROM e""",
    "rx",
)
def _(rx):
    q = rx.select("pid", "line", "unit", C.duration_qty(F.concat(F.col("qty").cast("decimal(10,1)").cast("string"), F.lit(" days"))).alias("qty_days"))
    return q.withColumn("days", C.duration_days("qty_days", "unit")).select("pid", "line", "qty_days", "days", C.duration_bucket("days").alias("bucket"))


@query("ag48_bucket_dist", "WITH b AS (SELECT CASE unit WHEN 'Cont.' THEN 999.0 WHEN 'Days' THEN qty WHEN 'Weeks' THEN qty * 7 WHEN 'Month' THEN qty * 30 END AS d FROM rx) SELECT CASE WHEN d IS NULL OR d <= 0 THEN 'NA' WHEN d <= 3 THEN '<=3d' WHEN d <= 7 THEN '4-7d' WHEN d <= 14 THEN '8-14d' WHEN d <= 30 THEN '15-30d' WHEN d <= 90 THEN '31-90d' WHEN d <= 1000 THEN '>90d/cont' ELSE 'NA' END AS bucket, count(*) AS n FROM b GROUP BY 1", "rx")
def _(rx):
    return rx.groupBy(C.duration_bucket(C.duration_days("qty", "unit")).alias("bucket")).agg(F.count("*").alias("n"))


@query("tx05_canon_dose", "WITH t AS (SELECT pid, line, trim(regexp_replace(lower(coalesce(dose, '')), '\\s+', ' ', 'g')) AS t FROM rx) SELECT pid, line, CASE WHEN regexp_full_match(t, '[\\d/\\s+\\-]+') THEN array_to_string(list_filter(regexp_split_to_array(t, '\\s*[+\\-]\\s*'), lambda x: x <> ''), '+') ELSE t END AS dose FROM t", "rx")
def _(rx):
    return rx.select("pid", "line", C.canon_dose("dose").alias("dose"))


_chapter = "CASE WHEN code IS NULL THEN NULL WHEN NOT regexp_matches(h, '^[A-Z][0-9]{2}$') THEN NULL " + " ".join(f"WHEN h BETWEEN '{a}' AND '{b}' THEN '{n}'" for a, b, n in ICD_CHAPTERS) + " ELSE 'other' END"


@query("tx28_icd_chapter", f"WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE ' ' || chr((65 + o_orderkey % 27)::INT) || lpad((o_orderkey * 7 % 100)::VARCHAR, 2, '0') || '.1' END AS code FROM orders), d AS (SELECT *, substr(upper(trim(code)), 1, 3) AS h FROM c) SELECT o_orderkey, {_chapter} AS chapter FROM d", "orders")
def _(orders):
    code = F.when(F.col("o_orderkey") % 19 != 0, F.concat(F.lit(" "), F.chr((65 + F.col("o_orderkey") % 27).cast("int")), F.lpad((F.col("o_orderkey") * 7 % 100).cast("string"), 2, "0"), F.lit(".1")))
    return orders.select("o_orderkey", C.icd_chapter(code).alias("chapter"))


@query("tx30_vitals_str", f"WITH {TYPED} SELECT pid, concat_ws(', ', 'BP ' || printf('%.0f', bp_sys) || '/' || printf('%.0f', bp_dia), 'pulse ' || printf('%.0f', pulse_rate), 'SpO2 ' || printf('%.0f', oxygen_of_blood) || '%', 'glucose ' || printf('%.1f', blood_glucose)) AS vitals FROM vit", "raw")
def _(raw):
    part = lambda head, c, tail="", fmt="%.0f": F.when(F.col(c).isNotNull(), F.concat(F.lit(head), F.format_string(fmt, c), F.lit(tail)))
    bp = F.when(F.col("bp_sys").isNotNull() & F.col("bp_dia").isNotNull(), F.format_string("BP %.0f/%.0f", "bp_sys", "bp_dia"))
    return vitals(raw).select("pid", F.concat_ws(", ", bp, part("pulse ", "pulse_rate"), part("SpO2 ", "oxygen_of_blood", "%"), part("glucose ", "blood_glucose", "", "%.1f")).alias("vitals"))


@query("sc01_date_parts", "SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, (isodow(ts) - 1)::INT AS wd, round((epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 8.64e10, 6) AS days FROM events", "events")
def _(ev):
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2020-01-01 00:00:00").cast("timestamp"))) / 8.64e10
    return ev.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.weekday("ts").alias("wd"), F.round(days, 6).alias("days"))


@query("sc02_math", "SELECT event_id, round(ln(1 + abs(value)), 6) AS l1, round(log2(1 + abs(value)), 6) AS l2, round(sqrt(abs(value)), 6) AS rt, round(sin(value), 6) AS s, round(greatest(least(value, 50), 10), 6) AS c FROM events", "events")
def _(ev):
    a = F.abs("value")
    return ev.select("event_id", F.round(F.log1p(a), 6).alias("l1"), F.round(F.log2(1 + a), 6).alias("l2"), F.round(F.sqrt(a), 6).alias("rt"), F.round(F.sin("value"), 6).alias("s"), F.round(F.greatest(F.least(F.col("value"), F.lit(50)), F.lit(10)), 6).alias("c"))


@query("sc03_zscore_clip", "WITH s AS (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM enc WHERE split = 'train') SELECT pid, round(coalesce(greatest(least((price - m) / sd, 6), -6), 0), 6) AS z, CASE WHEN price IS NULL THEN 0 ELSE 1 END AS present FROM enc, s", "enc")
def _(enc):
    from ..operators.vocab import norm_stats

    stats = norm_stats(enc, ["price"]).select(F.col("mean").alias("m"), F.col("std").alias("sd"))
    joined = enc.join(F.broadcast(stats))  # one row
    return joined.select("pid", F.round(C.zscore_clip("price", "m", "sd"), 6).alias("z"), F.col("price").isNotNull().cast("int").alias("present"))


@query("sc04_arrays", "WITH a AS (SELECT pid, list_sort(list_distinct(list(label))) AS s FROM rx GROUP BY pid) SELECT pid, len(s) AS n, array_to_string(list_sort(list_intersect(s, ['c1','c2','c3','c4','c5'])), ',') AS common, len(list_distinct(list_concat(s, ['c1','c2']))) AS n_union FROM a", "rx")
def _(rx):
    a = rx.groupBy("pid").agg(F.array_sort(F.collect_set("label")).alias("s"))
    five, two = F.array(*(F.lit(f"c{k}") for k in range(1, 6))), F.array(F.lit("c1"), F.lit("c2"))
    return a.select("pid", F.size("s").alias("n"), F.array_join(F.array_sort(F.array_intersect("s", five)), ",").alias("common"), F.size(F.array_union("s", two)).alias("n_union"))


@query("sc05_pad", "WITH a AS (SELECT pid, list(drug ORDER BY line, drug) AS d FROM rx GROUP BY pid) SELECT pid, array_to_string(list_concat(d[1:4], list_transform(range(0, greatest(4 - len(d[1:4]), 0)), lambda x: 0)), ',') AS padded FROM a", "rx")
def _(rx):
    a = rx.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("line", "drug"))).alias("d")).select("pid", F.transform("d", lambda x: x["drug"]).alias("d"))
    return a.select("pid", F.array_join(C.pad("d", 4, 0), ",").alias("padded"))


@query("sc06_strings", "SELECT conv_id, turn, upper(trim(coalesce(role, ''))) AS role, nullif(left(text, 12), '') AS head, length(text) AS n, regexp_replace(left(text, 40), '[^A-Za-z]+', '-', 'g') AS dashed, regexp_matches(text, '\\?') AS asks FROM conversations", "conversations")
def _(cv):
    return cv.select("conv_id", "turn", F.upper(F.trim(F.coalesce("role", F.lit("")))).alias("role"), F.nullif(F.left("text", F.lit(12)), F.lit("")).alias("head"), F.length("text").alias("n"), F.regexp_replace(F.left("text", F.lit(40)), "[^A-Za-z]+", "-").alias("dashed"), F.col("text").rlike(r"\?").alias("asks"))


@query("sc07_cosine", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 4) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS cosine FROM embeddings, q", "embeddings")
def _(em):
    q = em.agg(F.min_by("embedding", "vec_id").alias("q"))
    return em.join(F.broadcast(q)).select("vec_id", F.round(C.dot("embedding", "q"), 4).alias("dot"), F.round(C.cosine("embedding", "q"), 5).alias("cosine"))


@query("sc08_loose_json", "SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k, json_extract_string(props, '$.k') IS NOT NULL AS ok FROM events", "events")
def _(ev):
    wrapped = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("Sure, here it is:\n"), "props", F.lit("\nDone.")))
    k = C.parse_loose_json(wrapped, "k string")["k"]
    return ev.select("event_id", k.alias("k"), k.isNotNull().alias("ok"))


@query("sc09_prf", "WITH t AS (SELECT row_id, count(*) AS n_pred, sum(y) AS tp FROM (SELECT p.row_id, CASE WHEN EXISTS (SELECT 1 FROM gold g WHERE g.row_id = p.row_id AND g.label = p.label) THEN 1 ELSE 0 END AS y FROM (SELECT DISTINCT row_id, label FROM pred WHERE p >= 0.5) p) GROUP BY row_id), g AS (SELECT row_id, count(DISTINCT label) AS n_gold FROM gold GROUP BY row_id) SELECT g.row_id, round(coalesce(tp::DOUBLE / nullif(n_pred, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / n_gold, 0), 6) AS recall, round(coalesce(2.0 * tp / (n_pred + n_gold), 0), 6) AS f1 FROM g LEFT JOIN t USING (row_id)", "gold", "pred")
def _(gold, pred):
    from ..operators.metrics import row_counts

    c = row_counts(gold, pred.where("p >= 0.5")).where("n_gold > 0")
    return c.select("row_id", *(F.round(v, 6).alias(k) for k, v in C.prf("tp", "n_pred", "n_gold").items()))


@query("sc10_logit", "SELECT row_id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 5) AS logit, round(1 / (1 + exp(-p2)), 6) AS sig FROM bin", "bin")
def _(b):
    return b.select("row_id", F.round(C.logit("p"), 5).alias("logit"), F.round(C.sigmoid("p2"), 6).alias("sig"))

