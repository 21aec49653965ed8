"""Streams with a model and a policy inside, JDBC reads in ranges, and columns computed once a value."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clinmill.operators import vocab
from clinmill.sources import io
from clinmill.streaming.online import serve, stream_score


def test_stream_with_model_survives_a_stop(spark, tmp_path):
    """Rows that come before and after a stop, a micro-batch that is written twice, and a policy that changes between:
    every row once, decided as the batch does under the policy of its time."""
    rows = spark.range(400).select(F.col("id").alias("row_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x"), F.when(F.col("id") % 2 == 0, "drug").otherwise("test").alias("component"), (F.col("id") % 3 > 0).alias("sparse"))
    train = rows.withColumn("label", (F.col("x") > 0.4).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(maxIter=20, regParam=0.1)]).fit(train)
    policy = lambda cut: spark.createDataFrame([("drug", cut, True), ("test", 0.9, False)], "component string, cutpoint double, usable boolean")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    at = [f"{tmp_path}/{x}" for x in ("policy", "out", "log")]
    cols = ["row_id", "component", "cover", "confidence"]

    policy(0.5).write.parquet(at[0])
    rows.where("row_id < 100").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows.where("row_id >= 100 and row_id < 200").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    serve(stream(), model, *at, cols, "sparse")
    first = spark.read.parquet(at[1]).count()
    assert first == 200
    # the stop: the last micro-batch's output is there, its commit is not, so it runs again
    last = sorted((tmp_path / "log" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    policy(0.8).write.mode("overwrite").parquet(at[0])
    rows.where("row_id >= 200").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    serve(stream(), model, *at, cols, "sparse")
    got = {r["row_id"]: (r["component"], r["cover"], round(r["confidence"], 9)) for r in spark.read.parquet(at[1]).collect()}
    assert spark.read.parquet(at[1]).count() == 400 == len(got)
    want = {cut: {r["row_id"]: (r["component"], r["cover"], round(r["confidence"], 9)) for r in stream_score(rows, model, policy(cut), "sparse").collect()} for cut in (0.5, 0.8)}
    assert all(got[k] == want[0.5][k] or got[k] == want[0.8][k] for k in range(200))
    assert all(got[k] == want[0.8][k] for k in range(200, 400))
    assert any(want[0.5][k] != want[0.8][k] for k in range(400))
    serve(stream(), model, *at, cols, "sparse")  # nothing new
    assert spark.read.parquet(at[1]).count() == 400


@pytest.mark.parametrize("lo, hi, parts", [(0, 99, 4), (5, 6, 4), (7, 7, 3), (-10, 10, 5), (None, None, 4)])
def test_key_ranges_part_all_rows(spark, lo, hi, parts):
    df = spark.createDataFrame([(x,) for x in [None, *range(lo or 0, (hi or 0) + 1)]], "k int")
    ranges = io.key_ranges("k", lo, hi, parts)
    assert len(ranges) <= parts
    hits = df.select("k", *(F.expr(f"CASE WHEN {r} THEN 1 ELSE 0 END").alias(f"r{i}") for i, r in enumerate(ranges))).collect()
    assert all(sum(x[1:]) == 1 for x in hits)


def test_jdbc_in_parts(spark):
    url = "jdbc:derby:memory:parts;create=true"
    df = spark.range(1000).select(F.when(F.col("id") != 17, F.col("id")).alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1.5).alias("w"))
    io.save_table(df, "parts", url)
    got = io.load_table(spark, "parts", url, '"k"', 4, ["k", "v"])
    assert got.rdd.getNumPartitions() == 4
    assert sorted((x["k"] is None, x["k"], x["v"]) for x in got.collect()) == sorted((x["k"] is None, x["k"], x["v"]) for x in df.collect())
    plan = got._jdf.queryExecution().toString()
    assert "ReadSchema: struct<k:bigint,v:string>" in plan
    io.save_table(df.limit(0), "nothing", url)
    assert io.load_table(spark, "nothing", url, '"k"').count() == 0
    assert io.load_table(spark, "parts", url).count() == 1000


def test_per_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, ""), (5, "b")], "id int, note string")
    got = {r["id"]: (r["note"], r["n"]) for r in vocab.per_value(df, "note", {"n": F.coalesce(F.length("note"), F.lit(-1))}).collect()}
    assert got == {1: ("a", 1), 2: (None, -1), 3: ("a", 1), 4: ("", 0), 5: ("b", 1)}
    assert vocab.per_value(df.limit(0), "note", {"n": F.length("note")}).count() == 0
