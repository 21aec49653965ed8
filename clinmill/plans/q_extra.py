"""Queries over sources and sinks (written to the shared folder and read again), feature sets, input permutation
and the text-representation ablation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import ablation as AB
from ..operators import models as ML
from ..sources import io
from ..sources.scratch import scratch
from .base import STANDINS, query

R6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

RAW = list(STANDINS["raw"][1])


@query("io01_io02_csv", "SELECT " + ", ".join(f"nullif(CAST({c} AS VARCHAR), '') AS {c}" for c in RAW) + " FROM raw", "raw")
def _(raw):
    """An extract, quoted and ordered, read back as text in which only the empty field is null."""
    path = scratch(raw.sparkSession)
    io.write_extract(raw, path, ["pid"])
    return io.read_raw(raw.sparkSession, path, raw.columns)


@query("io03_parquet_fact", "SELECT pid, uid, CAST(CAST(visit AS DATE) AS VARCHAR) AS visit, status, price FROM enc", "enc")
def _(enc):
    path = scratch(enc.sparkSession)
    io.write_fact(enc, path, ["pid", "uid", "visit", "price", "status"], ["status"])
    return io.read_fact(enc.sparkSession, path, ["pid", "uid", "visit", "status", "price"]).withColumn("visit", F.col("visit").cast("date").cast("string"))


@query("io05_json_artefact", "SELECT kind, status, count(*) AS n, round(avg(price), 4) AS mean FROM enc GROUP BY 1, 2", "enc")
def _(enc):
    path = scratch(enc.sparkSession)
    report = enc.groupBy("kind", "status").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"))
    io.write_json(report, path)
    return enc.sparkSession.read.schema(report.schema).json(path)


@query("io06_annotations", "SELECT 'a' || (pid // 40) % 5 AS annotator, 'p' || pid AS ann_id, status AS preference, CASE WHEN uid % 3 = 0 THEN 'unsafe' END AS safety1 FROM enc", "enc")
def _(enc):
    """Returned packets, of at most forty answers each, to a row per answer."""
    path = scratch(enc.sparkSession)
    answer = F.struct(F.col("status").alias("preference"), F.when(F.col("uid") % 3 == 0, "unsafe").alias("safety1"))
    packets = enc.groupBy(F.floor(F.col("pid") / 40).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("p"), F.col("pid").cast("string")), answer))).alias("answers"))
    io.write_json(packets.select(F.concat(F.lit("a"), (F.col("k") % 5).cast("string")).alias("annotator"), "answers"), path)
    return io.read_annotations(enc.sparkSession, path, lines=True).select("annotator", "ann_id", "preference", "safety1")


@query("io07_relational", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2", "customer", "nation", "region")
def _(customer, nation, region):
    """Relations written to a database and read back in ranges of their keys; the extract's joins run in Spark.

    The database is that of spark.clinmill.jdbc.url. A local session, whose tasks share its JVM, may go without: it has
    one in memory. Elsewhere the relations then come from the catalog."""
    spark = customer.sparkSession
    url = spark.conf.get("spark.clinmill.jdbc.url", None)
    if url is None and spark.sparkContext.master.startswith("local["):
        url = f"jdbc:derby:memory:clinmill{uuid.uuid4().hex};create=true"
    got = []
    for name, df, key in (("customer", customer.select("c_custkey", "c_nationkey"), "c_custkey"), ("nation", nation.select("n_nationkey", "n_regionkey", "n_name"), "n_nationkey"), ("region", region.select("r_regionkey", "r_name"), "r_regionkey")):
        if url:
            io.save_table(df, f"clinmill_{name}", url)
        else:
            df.createOrReplaceTempView(f"clinmill_{name}")
        got.append(io.load_table(spark, f"clinmill_{name}", url, f'"{key}"', 4 if name == "customer" else 1))
    c, n, r = got
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


BLOCKS = {"text": ["chars", "words"], "physio": ["price", "age"], "clinical": ["male"], "context": ["n_site"]}
_SUM = {b: " + ".join(c) for b, c in BLOCKS.items()}


@query(
    "fe11_feature_sets",
    "WITH x AS (SELECT length(note)::DOUBLE AS chars, len(string_split(note, ' '))::DOUBLE AS words, coalesce(price, 0) AS price, coalesce(age, 0) AS age, CASE WHEN sex = 'M' THEN 1.0 ELSE 0.0 END::DOUBLE AS male, (uid % 40)::DOUBLE AS n_site FROM enc) "
    + " UNION ALL ".join(f"SELECT '{n}' AS feature_set, {str(ok).lower()} AS deployable, {sum(len(BLOCKS[b]) for b in blocks)}::INT AS n_features, count(*) AS n, round(sum({' + '.join(_SUM[b] for b in blocks)}), 2) AS total FROM x" for n, (blocks, ok) in ML.FEATURE_SETS.items()),
    "enc",
)
def _(enc):
    x = enc.select(F.length("note").cast("double").alias("chars"), F.size(F.split("note", " ", -1)).cast("double").alias("words"), F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce("age", F.lit(0.0)).cast("double").alias("age"), F.when(F.col("sex") == "M", 1.0).otherwise(0.0).alias("male"), (F.col("uid") % 40).cast("double").alias("n_site"))
    return ML.feature_set_table(x, BLOCKS).withColumn("total", F.round("total", 2))


@query("ev20_modality_permutation", None, "enc")
def _(enc):
    """Which inputs a fitted model of three properties of an encounter uses."""
    from ..operators.features import numeric_block

    cols = ["price", "age", "chars", "visit_year"]
    b = numeric_block(enc.select(F.col("pid").alias("row_id"), "split", "price", "age", F.length("note").cast("double").alias("chars"), F.col("year").cast("double").alias("visit_year")), cols, F.col("split") == "train")
    blocks = {"text": ["chars"], "physio": ["price", "age"], "clinical": ["visit_year"]}
    pipe = ML.feature_set("deployable", blocks).fit(b)
    of = F.array_compact(F.array(F.when(F.col("age") < 45, "young"), F.when(F.length("note") > 25, "long"), F.when(F.col("price") > 200_000, "dear")))
    gold = enc.select(F.col("pid").alias("row_id"), F.explode(of).alias("label"))
    models = ML.fit_ovr(pipe.transform(b.where("split = 'train'")), gold, ["young", "long", "dear"])
    test = b.where("split = 'test'").select("row_id", *cols)
    predict = lambda d: ML.score_ovr(models, pipe.transform(d)).where("p >= 0.5").select("row_id", "label")
    out = ML.permutation_report(test, {**blocks, "all": cols}, predict, gold.join(test, "row_id", "left_semi"))
    return R6(out, "micro_f1", "jaccard", "delta_micro_f1")


@query("ev23_text_ablation", None, "enc")
def _(enc):
    """Six ways to read a note, scored on two findings and on a label that notes don't tell."""
    notes = enc.select(F.col("pid").alias("row_id"), "split", "note")
    of = F.array_compact(F.array(F.when(F.lower("note").rlike("pain|lbp|ache"), "pain"), F.when(F.lower("note").rlike("d/m|dm|htn"), "chronic"), F.when(F.col("status") == "F", "other")))
    gold = enc.select(F.col("pid").alias("row_id"), F.explode(of).alias("label"))
    out = AB.ablation(notes, "note", gold, ["pain", "chronic", "other"])
    return R6(out, *[c for c in out.columns if c != "arm"])
