import datetime as dt

import pytest
from pyspark.sql import functions as F

from clinmill.functions import clean as C
from clinmill.functions import text as T


def one(spark, value, col, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(col).collect()]


def test_duration_and_buckets(spark):
    assert one(spark, ["৭", "7", "0", "366", "5 days", "", None], C.duration_qty("x")) == [7.0, 7.0, None, None, 5.0, None, None]
    assert one(spark, [0.0, 3.0, 3.5, 7.0, 14.0, 30.0, 90.0, 999.0, 1001.0, None], C.duration_bucket("x"), "double") == ["NA", "<=3d", "4-7d", "4-7d", "8-14d", "15-30d", "31-90d", ">90d/cont", "NA", "NA"]
    assert one(spark, [dt.date(2020, 1, 1)], C.age_years(F.lit("2019-05-05").cast("date"), "x"), "date") == [None]


def test_dose(spark):
    assert one(spark, ["1+0+1", "1-0-1", "1 + 0 + 1", "1/2+0+1/2", "SOS", "", None], C.canon_dose("x")) == ["1+0+1", "1+0+1", "1+0+1", "1/2+0+1/2", "sos", "", ""]


def test_unit_repair(spark):
    assert one(spark, [1.0, 5.6, 20.0, 20.1, 600.0, None], C.harmonise_glucose("x"), "double") == pytest.approx([18.0, 100.8, 360.0, 20.1, 600.0, None])
    assert one(spark, [29.9, 30.0, 37.0, 45.0, 45.1], C.harmonise_temperature("x"), "double") == pytest.approx([29.9, 86.0, 98.6, 113.0, 45.1])
    assert one(spark, ["x", "1.5", None], C.num("x")) == [None, 1.5, None]


def test_blood_pressure(spark):
    df = spark.createDataFrame([(119.0, 79.0), (120.0, 79.0), (130.0, 79.0), (129.0, 80.0), (140.0, 70.0), (160.0, 100.0), (None, 95.0)], "s double, d double")
    b = C.bp_category("s", "d")
    assert [r[0] for r in df.select(b["bp_cat"]).collect()] == [0, 1, 2, 2, 3, 3, None]
    full = df.withColumnsRenamed({"s": "bp_sys", "d": "bp_dia"}).selectExpr("*", "cast(null as double) blood_glucose", "'NA' glucose_type", "cast(null as double) bmi", "cast(null as double) blood_hemoglobin", "'M' sex", "cast(null as double) oxygen_of_blood", "cast(null as double) pulse_rate")
    got = [(r["hypertension_who"], r["diabetes_range"], r["ncd_multimorbid"]) for r in C.ncd_flags(full).collect()]
    assert got[-1] == (1.0, None, 0.0) and got[0] == (0.0, None, 0.0)


def test_mojibake(spark):
    bad = "১১".encode().decode("latin-1")
    assert one(spark, [bad, "à la carte", "plain", "১", None], T.norm_text("x")) == ["11", "à la carte", "plain", "1", ""]
    assert one(spark, ["ﬁne ①", "plain"], T.norm_text("x", compatible=True)) == ["fine 1", "plain"]


def test_glossary(spark):
    assert one(spark, ["D/M, HTN"], T.expand_glossary("x")) == ["Diabetes Mellitus, Hypertension"]
    assert one(spark, ["lbp and low back pain"], T.expand_glossary("x", "joined")) == ["low_back_pain and low back pain"]
    assert one(spark, ["lbp and low back pain"], T.expand_glossary("x", "canonical")) == ["low_back_pain and low_back_pain"]
    assert one(spark, ["lbp here"], T.expand_glossary("x", "augmented")) == ["lbp low_back_pain here"]


def test_segment(spark):
    notes = ["1. pain in abdomen 2. fever for 3 days", "leg pain for 2 months", "rt knee pain, rt", "no complaint", "general check up", "a 1.5 mg dose", None, "cough; cold & fever + chills"]
    got = one(spark, notes, T.segment("x"))
    assert got == [["pain in abdomen", "fever for 3 days"], ["leg pain for 2 months"], ["rt knee pain rt"], [], [], ["a 1.5 mg dose"], [], ["cough", "cold", "fever", "chills"]]
    assert one(spark, ["leg pain for 2 months"], T.span_keys(T.segment("x"))) == [["leg pain"]]


def test_no_complaint_variants(spark):
    assert one(spark, ["NO", "healthy", "general check up", "no specific complaints.", "", "no pain"], T.is_no_complaint("x")) == [True, False, True, True, False, False]
    assert one(spark, ["NO", "healthy", "general check up", "no pain"], T.is_no_complaint("x", "note")) == [True, True, True, False]


def test_icd_chapter(spark):
    assert one(spark, ["I10", "z00.1", "U07", "1A0", "", None, "D50"], C.icd_chapter("x")) == ["circulatory", "health_status", "other", None, None, None, "blood"]


def test_wilson_and_prf(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k long, n long")
    w = C.wilson("k", "n")
    a, b = df.select(w["lo"].alias("lo"), w["hi"].alias("hi")).collect()
    assert (a["lo"], a["hi"]) == pytest.approx((0.4901, 0.9433), abs=1e-3) and (b["lo"], b["hi"]) == (0.0, 0.0)
    m = C.prf(F.lit(0), F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(*m.values()).first()) == (0.0, 0.0, 0.0)


def test_loose_json(spark):
    assert one(spark, ['{"a": 1}', 'Sure:\n{"a": 2}\nok', "no"], C.parse_loose_json("x", "a int")["a"]) == [1, 2, None]
