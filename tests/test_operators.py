import pytest
from pyspark.sql import functions as F

from clinmill.operators import abstain as AB
from clinmill.operators import assemble as A
from clinmill.operators import calibrate as CA
from clinmill.operators import features as FE
from clinmill.operators import merge as M
from clinmill.operators import metrics as EV
from clinmill.operators import split as S
from clinmill.operators import vocab as VO
from clinmill.sources import io
from clinmill.streaming.online import run_once, stream_clean


def test_patient_split_shares_and_stability(spark):
    enc = spark.range(1000).select(F.col("id").alias("uid"))
    got = S.patient_split(enc, "uid")
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert n == {"test": 200, "val": 100, "train": 700}
    assert got.exceptAll(S.patient_split(enc.repartition(9), "uid")).count() == 0
    assert S.straddlers(enc.join(got, "uid"), "uid").count() == 0


def test_merge_proofs_pass_and_a_broken_offset_fails(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pid long, v string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "pid long, v string")
    good = {"a": 0, "b": 100}
    rep = M.verify_ids({"a": a, "b": b}, M.merge_corpora({"a": a, "b": b}, good, ["pid"]), "pid", good)
    M.require(rep)
    bad = M.verify_ids({"a": a, "b": b}, M.merge_corpora({"a": a, "b": b}, {"a": 0, "b": 1}, ["pid"]), "pid", good)
    with pytest.raises(ValueError):
        M.require(bad)
    with pytest.raises(ValueError):
        M.merge_corpora({"c": a}, good, ["pid"])


def test_vocab_ids_are_dense_and_ordered(spark):
    f = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("rare", 1), ("ab", 5), ("aa", 5)], "token string, freq long")
    ids = {r["token"]: r["id"] for r in VO.build_vocab(f, 2).collect()}
    assert [k for k, _ in sorted(ids.items(), key=lambda x: x[1])] == ["<pad>", "<bos>", "<eos>", "<unk>", "c", "a", "aa", "ab", "b"]
    enc = VO.encode_ids(spark.createDataFrame([(1, ["c", "zzz", "a"])], "k long, t array<string>"), "k", F.col("t"), VO.build_vocab(f, 2))
    assert enc.first()["ids"] == [4, 3, 5]


def test_set_metrics_on_empty_sets(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "row_id long, label string")
    pred = spark.createDataFrame([(1, "a"), (2, "c")], "row_id long, label string")
    m = EV.set_metrics(rows, gold, pred).first()
    assert m["jaccard"] == pytest.approx((0.5 + 0 + 1) / 3) and m["exact_match"] == pytest.approx(1 / 3)
    assert m["micro_f1"] == pytest.approx(2 / 4)


def brute_auroc(p, y):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auroc_with_ties(spark):
    p, y = [0.1, 0.4, 0.4, 0.8, 0.8, 1.0, 0.0], [0, 1, 0, 1, 0, 1, 0]
    df = spark.createDataFrame(list(zip(p, y)), "p double, y int")
    assert EV.auroc(df, []).first()["auroc"] == pytest.approx(brute_auroc(p, y))


def test_risk_coverage_against_a_sort(spark):
    rows = [(k, [0.0, 0.3, 0.3, 0.9][k % 4], k % 3, 2, 2) for k in range(200)]
    df = spark.createDataFrame(rows, "row_id long, c double, tp long, n_pred long, n_gold long")
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for r in AB.risk_coverage(df, "c").collect():
        top = order[: r["n"]]
        assert r["micro_f1"] == pytest.approx(2 * sum(x[2] for x in top) / sum(x[3] + x[4] for x in top))


def test_decide_needs_no_other_row(spark):
    pol = spark.createDataFrame([("d", 0.5, True), ("t", 0.5, False)], "component string, cutpoint double, usable boolean")
    conf = spark.createDataFrame([("d", 0.4, True), ("d", 0.4, False), ("d", 0.6, True), ("t", 0.1, True), ("x", 0.1, True)], "component string, confidence double, sparse boolean")
    glob = [r["cover"] for r in AB.decide(conf, pol).orderBy("component", "confidence", "sparse").collect()]
    assert glob == [False, False, True, True, True]
    assert AB.decide(conf, pol, "sparse").where("not cover").count() == 1


def test_isotonic_knots_interpolate(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.6, 1), (0.9, 1)] * 20, "p double, y int")
    got = CA.calibrate(df, df.select("p").distinct(), "isotonic").orderBy("p").collect()
    cal = [r["p_cal"] for r in got]
    assert cal == sorted(cal) and cal[0] == 0.0 and cal[-1] == 1.0 and cal[1] == pytest.approx(0.5)
    few = CA.calibrate(df.limit(3), df, "isotonic")
    assert few.where("p_cal <> p").count() == 0


def test_leave_one_out_never_sees_its_own_row(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 0.0, True), ("a", 0.0, False), (None, 1.0, True), ("new", 1.0, False)], "k string, y double, t boolean")
    got = {(r["k"], r["t"]): r["enc"] for r in FE.loo_target_encode(df, "k", "y", F.col("t")).collect()}
    prior = 2 / 3
    assert got["a", True] == pytest.approx(prior) and got["a", False] == pytest.approx((1 + 20 * prior) / 21)
    assert got[None, True] is None and got["new", False] == pytest.approx(prior)


def test_prior_visits_exclude_ties(spark):
    enc = spark.createDataFrame([(1, 7, "2020-01-01"), (2, 7, "2020-01-01"), (3, 7, "2020-02-01"), (4, 8, "2020-03-01")], "pid long, uid long, d string").select("pid", "uid", F.to_date("d").alias("visit"))
    got = {r["pid"]: r["prior"] for r in A.prior_visits(enc).collect()}
    assert got == {1: [], 2: [], 3: [1, 2], 4: []}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q", x\ny', None), ("2", "০১", "")], "id string, t string, n string")
    io.write_extract(df, f"{tmp_path}/x", ["id"])
    back = io.read_raw(spark, f"{tmp_path}/x", ["id", "t", "n"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q", x\ny', None), ("2", "০১", None)]


def test_facts_json_and_annotations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, t string, v double")
    io.write_fact(df, f"{tmp_path}/f", ["v", "id"])
    assert io.read_fact(spark, f"{tmp_path}/f", ["id"]).collect() == [(1,)]
    io.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first()["t"] == "a"
    (tmp_path / "annotations_a.json").write_text('{"annotator": "a",\n "answers": {"i1": {"icd1": "I10", "preference": "1"}, "i2": {"safety1": "unsafe"}}}')
    got = {r["ann_id"]: (r["annotator"], r["icd1"], r["safety1"]) for r in io.read_annotations(spark, f"{tmp_path}/annotations_*.json").collect()}
    assert got == {"i1": ("a", "I10", None), "i2": ("a", None, "unsafe")}
    df.createOrReplaceTempView("rel")
    assert io.load_table(spark, "rel").count() == 1
    with pytest.raises(ValueError):
        io.require_columns(df, df.drop("v"))
    assert io.dtype_drift(df, df.withColumn("id", F.col("id").cast("string"))) == [("id", "bigint", "string")]


def test_stream_equals_batch(spark, tmp_path):
    from clinmill.plans.base import frame

    raw = frame(spark, "/root/testdata/sf0.001", "raw").limit(300)
    raw.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    run_once(stream_clean(stream), f"{tmp_path}/out", f"{tmp_path}/log")
    batch = stream_clean(spark.read.parquet(f"{tmp_path}/in"))
    got = spark.read.parquet(f"{tmp_path}/out").select(*batch.columns)
    assert got.exceptAll(batch).count() == 0 and got.count() == 300


def test_row_counts_in_one_shuffle(spark):
    """Counts without a join: copies count once, rows keep their number, null labels and rows equal nothing."""
    from clinmill.operators import metrics as EV

    frame = lambda rows: spark.createDataFrame(rows, "row_id long, label string")
    gold = frame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, None), (None, "a")])
    pred = frame([(1, "a"), (2, "d"), (2, None), (9, "z")])
    rows = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "row_id long")
    counts = EV.row_counts(gold, pred, rows)
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([(1, 1, 1, 2), (2, 0, 2, 2), (3, 0, 0, 0), (3, 0, 0, 0), (None, 0, 0, 0)], key=str)
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_multi_hot_without_join(spark):
    """More labels than a mask has bits, copies of links, rows without links and twice, null keys."""
    from clinmill.operators import vocab as VO

    values = [f"v{k}" for k in range(70)]
    enc = spark.createDataFrame([(1,), (2,), (2,), (None,)], "pid long")
    link = spark.createDataFrame([(1, "v0"), (1, "v0"), (1, "v59"), (1, "v60"), (2, "v69"), (2, "other"), (5, "v1"), (None, "v2")], "pid long, label string")
    out = VO.multi_hot(enc, link, "pid", "label", values)
    got = sorted([(r["pid"], [v for v in values if r[v]]) for r in out.collect()], key=str)
    assert got == sorted([(1, ["v0", "v59", "v60"]), (2, ["v69"]), (2, ["v69"]), (None, [])], key=str)
    assert out.columns == ["pid", *values] and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rank_equivalence_cuts_at_whole_rank(spark, monkeypatch):
    """1 - 0.8 is asked for as 0.2, as SQL writes it."""
    from clinmill.operators import abstain as AB

    asked = []
    monkeypatch.setattr(AB, "quantiles", lambda df, want: asked.append(want) or {"c": [2.0]})
    AB.rank_equivalence(spark.createDataFrame([(float(k),) for k in range(6)], "c double"), "c", 0.8).collect()
    assert asked == [{"c": [0.2]}]


@pytest.mark.parametrize("files", [1, 3])
def test_confidence_adds_up_in_the_order_of_the_table(spark, tmp_path, files):
    """Bit by bit the sums of one DuckDB thread, though rows arrive from many tasks, and from files whose sizes and names go unlike."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    r, n = np.random.default_rng(4), 6000
    cut = np.split(np.arange(n), {1: [], 3: [500, 2000]}[files])  # the largest file comes last
    row, p = r.integers(0, 400, n), r.integers(0, 101, n) / 100.0
    for k, at in enumerate(cut):
        pq.write_table(pa.table({"row_id": row[at], "label": [f"c{x}" for x in at % 12], "p": pa.array([None if x % 50 == 7 else p[x] for x in at])}), str(tmp_path / f"part-{k}.parquet"), row_group_size=100)
    with duckdb.connect() as c:
        c.execute("set threads = 1")
        sql = "select row_id, 2 * sum(case when p >= 0.5 then p else 0 end) / greatest(count_if(p >= 0.5) + sum(p), 1e-9) from read_parquet(?) group by row_id"
        want = dict(c.execute(sql, [str(tmp_path / "*.parquet")]).fetchall())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        pred = spark.read.parquet(str(tmp_path))
        assert pred.rdd.getNumPartitions() > 5
        late = lambda d, *keys, of=None: d.orderBy(F.xxhash64("p", "row_id"))  # noqa: E731  rows come in another order
        with pytest.MonkeyPatch.context() as m:
            m.setattr(AB, "spread", late)
            got = {x["row_id"]: x["expected_f1"] for x in AB.confidence(pred, 0.5).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == want


def test_spread_takes_partitions_by_file_size(spark, tmp_path):
    """A folder with a space in its name; a partition for each piece, at least eight."""
    from clinmill.sources.scratch import spread

    spark.range(20_000).write.parquet(str(tmp_path / "a b"))
    df = spark.read.parquet(str(tmp_path / "a b"))
    size = sum(p.stat().st_size for p in (tmp_path / "a b").glob("part-*"))
    out = spread(df, "id", piece=1_000)
    assert out.rdd.getNumPartitions() == -(-size // 1_000) > 8 and out.count() == 20_000
    assert spread(df, "id").rdd.getNumPartitions() == 8


def test_spread_takes_partitions_by_rows_of_well_packed_files(spark, tmp_path):
    """Many rows in few bytes: a partition for each `rows` rows, also in a folder whose name reads like a pattern."""
    from clinmill.sources.scratch import spread

    where = str(tmp_path / "p[1]{x}*")
    spark.range(300_000).selectExpr("id div 100000 AS row_id").write.parquet(where)
    df = spark.read.parquet(where.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}").replace("*", "\\*"))
    assert df.count() == 300_000
    assert spread(df, "row_id", rows=20_000).rdd.getNumPartitions() == 15
    assert spread(df, "row_id", of=df.unionAll(df)).rdd.getNumPartitions() == 8
    spark.range(3_000_000).selectExpr("id div 1000000 AS row_id").write.parquet(str(tmp_path / "few_bytes"))
    assert spread(spark.read.parquet(str(tmp_path / "few_bytes")), "row_id").rdd.getNumPartitions() == 12


@pytest.mark.parametrize("name", ["ab13_sparse_table", "ev22_by_group"])
def test_encounters_are_not_broadcast(spark, name):
    """As many as the rows, they are a small table only by the bytes of their file."""
    from clinmill.plans import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 1
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["sc09_prf", "jn20_match_predictions"])
def test_row_counts_take_a_partition_for_so_many_rows(spark, tmp_path, name):
    """By bytes the eight partitions that are the least would do."""
    from clinmill.plans import QUERIES

    line = spark.range(2_400_000, numPartitions=2).selectExpr("id div 800000 AS l_orderkey", "1L AS l_partkey", "1L AS l_suppkey", "1L AS l_linenumber")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(3).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE'2000-01-01' AS o_orderdate", "1.0D AS o_totalprice", "'a' AS o_orderpriority", "'F' AS o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    assert "row_id" in df.columns and df.count() == 3
    assert df.rdd.getNumPartitions() == 10


def test_spread_into_many_partitions_goes_by_few(spark, tmp_path):
    """Beyond DIRECT partitions a task of the scan would hold its whole split; the tasks between hold even parts of the rows."""
    from clinmill.sources import scratch

    spark.range(100_000, numPartitions=1).selectExpr("id % 50000 AS row_id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    steps = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert steps(scratch.spread(df, "row_id", rows=500)) == 1
    many = scratch.spread(df, "row_id", rows=400)
    assert steps(many) == 2 and many.rdd.getNumPartitions() == 250 and many.columns == ["row_id"]
    assert many.groupBy("row_id").count().where("count = 2").count() == 50_000
    first = many._jdf.queryExecution().optimizedPlan().children().head().children().head()
    between = df.withColumn("__d", F.xxhash64("row_id")).repartition(scratch.DIRECT, "__d")
    assert "RepartitionByExpression [__d" in first.toString().splitlines()[0]
    assert between.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2 * 100_000 / scratch.DIRECT


@pytest.mark.parametrize("name", ["sc09_prf", "jn20_match_predictions"])
def test_row_counts_in_two_steps_equal_sql(spark, monkeypatch, name):
    import duckdb

    from clinmill.plans import ORACLE_SQL, QUERIES
    from clinmill.sources import scratch

    monkeypatch.setattr(scratch, "DIRECT", 4)
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    want = con.execute(ORACLE_SQL[name].replace(" AS STRING", " AS VARCHAR"))
    cols = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.fetchall())


def test_merge_proofs_count_what_is_broken(spark):
    """Lost, doubled, changed and re-parented rows, and null ids, each in its own check; no check sorts or holds a whole corpus."""
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (None, "z")], "pid long, v string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "pid long, v string")
    frames, off = {"a": a, "b": b}, {"a": 0, "b": 100}
    m = M.merge_corpora(frames, off, ["pid"])
    broken = m.where("pid is null or pid <> 103").withColumn("v", F.when(F.col("pid") == 101, "P").otherwise(F.col("v")))
    kid = {"a": spark.createDataFrame([(1,), (9,)], "pid long"), "b": spark.createDataFrame([(1,), (3,)], "pid long")}
    child = M.merge_corpora(kid, off, ["pid"]).withColumn("corpus", F.when(F.col("pid") == 101, "a").otherwise(F.col("corpus")))
    got = {r["check"]: (r["passed"], r["detail"]) for r in M.verify_ids(frames, broken, "pid", off, {"rx": (kid, child)}).collect()}
    assert got == {
        "collision_is_real": (True, "2"), "merged_id_unique": (False, "2"), "bijection": (False, "1"), "source_ids_round_trip": (False, "1"),
        "blocks_disjoint": (True, "0"), "no_id_crosses_corpora": (True, "0"), "no_child_re_parented_rx": (False, "1"), "resolution_rx": (False, "1"),
        "slice_equals_source_a": (True, "0"), "slice_equals_source_b": (False, "3"),
    }


def test_merge_proofs_take_the_orders_as_children(spark, monkeypatch):
    """Every order of a corpus is a child under its encounter's new id; encounters without orders, orders of other kinds, of none and without a key are none."""
    from clinmill.plans import q_profile as Q

    seen, proofs = [], M.verify_ids
    monkeypatch.setattr(M, "verify_ids", lambda *a: seen.append(a[4]["rx"]) or proofs(*a))
    enc = spark.createDataFrame([(10, "1-URGENT"), (20, "1-URGENT"), (11, "2-HIGH"), (15, "4-NONE"), (31, "3-MEDIUM"), (31, "3-MEDIUM"), (None, "3-MEDIUM")], "pid long, kind string")
    rx = spark.createDataFrame([(20, 1), (20, 2), (20, 3), (11, 1), (15, 1), (31, 1), (99, 1), (None, 1)], "pid long, line int")
    rep = Q._proof(enc, rx).collect()
    (own, merged), = seen
    rows = lambda d: sorted(r["pid"] for r in d.collect())
    assert {k: rows(d) for k, d in own.items()} == {"1-URGENT": [2, 2, 2], "2-HIGH": [1], "3-MEDIUM": [2, 3]}
    assert rows(merged) == [2, 2, 2, 100_000_001, 200_000_002, 200_000_003]
    assert all(r["passed"] for r in rep) and len(rep) == 11


def test_numbers_in_a_group_are_ranked_in_ranges(spark):
    rows = [(k * k, "g" if k % 3 else "h") for k in range(1000)]
    got = M.numbered(spark.createDataFrame(rows, "k long, g string"), "g", "k", "n", most=50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    want = [(k, g, 1 + sum(1 for j, h in rows if h == g and j < k)) for k, g in rows]
    assert "normalizenanandzero" not in plan
    one = M.numbered(spark.createDataFrame(rows, "k long, g string"), "g", "k", "n")  # a single range
    assert sorted(map(tuple, one.select("k", "g", "n").collect())) == sorted(want)
    assert sorted(map(tuple, got.select("k", "g", "n").collect())) == sorted(want) and "row_number() windowspecdefinition(g" in plan and "__b" in plan
