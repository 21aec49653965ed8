"""Registry of queries and the clinical stand-ins that are derived from the driver's tables.

A stand-in is a list of SQL expressions that Spark and DuckDB read alike, so a query and its oracle
start from the same rows and share nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOTES = (
    "general check up", "1. pain in abdomen 2. fever for 3 days", "leg pain for 2 months", "D/M, HTN", "h/o DM + h/o asthma",
    "rt knee pain, rt", "<b>fever</b> and cough; cold", "NO", "Nil", "low back pain since 3 years & LBP", "haemoglobin low; anaemia",
    "hospitalisation for diarrhoea", "headache, vertigo, vomiting", "c/o SOB, chest pain for last 5 days", "healthy", "no specific complaints.",
    "burning sensation; frequency of urine", "itching skin rash for several weeks", "ischaemic heart disease", "", "follow up of HTN, uncontrolled",
    "1. weakness 2. anorexia 3. insomnia for long time", "swelling of rt leg + numbness", "joint pain; oesophagus; tumour; exercise",
)

_note = "CASE CAST(o_orderkey % 24 AS INT) " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NOTES)) + " END"

STANDINS: dict[str, tuple[str, dict[str, str]]] = {
    # raw encounters: text columns as an extract has them, with bad values and gaps
    "raw": ("orders", {
        "pid": "CAST(o_orderkey AS STRING)",
        "uid": "CAST(o_custkey AS STRING)",
        "site_id": "CASE WHEN o_custkey % 50 = 0 THEN 'x' ELSE CAST(o_custkey % 40 AS STRING) END",
        "visit": "CASE WHEN o_orderkey % 101 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
        "born": "CAST(1900 + (o_custkey * 7) % 125 AS STRING) || '-01-01'",
        "sex": "CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'male' WHEN 1 THEN 'F' WHEN 2 THEN ' Female' WHEN 3 THEN '' ELSE 'x' END",
        "height": "CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(55 + (o_orderkey * 13) % 180 AS STRING) END",
        "weight": "CAST(5 + (o_orderkey * 7) % 260 AS STRING)",
        "bmi": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(8 + (o_orderkey * 3) % 560 / 10.0 AS DECIMAL(10, 1)) AS STRING) END",
        "waist_hip_ratio": "CAST(CAST(0.3 + (o_orderkey % 17) / 10.0 AS DECIMAL(10, 2)) AS STRING)",
        "temperature": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(28 + o_orderkey % 20 AS STRING) ELSE CAST(88 + o_orderkey % 25 AS STRING) END",
        "oxygen_of_blood": "CAST(45 + (o_orderkey * 11) % 60 AS STRING)",
        "bp_sys": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(50 + (o_orderkey * 17) % 220 AS STRING) END",
        "bp_dia": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(25 + (o_orderkey * 19) % 170 AS STRING) END",
        "blood_glucose": "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN CAST(CAST((o_orderkey % 43) / 2.0 AS DECIMAL(10, 1)) AS STRING) WHEN 1 THEN NULL ELSE CAST(15 + (o_orderkey * 23) % 620 AS STRING) END",
        "glucose_type": "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'FBS' WHEN 1 THEN 'PBS' WHEN 2 THEN 'fbs ' WHEN 3 THEN 'FBS2' END",
        "blood_hemoglobin": "CAST(2 + (o_orderkey * 3) % 23 AS STRING)",
        "pulse_rate": "CAST(25 + (o_orderkey * 29) % 190 AS STRING)",
        "cholesterol": "CAST(40 + (o_orderkey * 31) % 480 AS STRING)",
        "uric_acid": "CAST(CAST((o_orderkey % 45) / 2.0 AS DECIMAL(10, 1)) AS STRING)",
        "smoker": "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'Yes ' WHEN 1 THEN 'no' END",
        "note": _note,
    }),
    # clean encounters
    "enc": ("orders", {
        "pid": "o_orderkey",
        "uid": "o_custkey",
        "prescriber": "CAST(o_orderkey % 37 AS INT)",
        "site": "CAST(o_custkey % 29 AS INT)",
        "visit": "CAST(o_orderdate AS DATE)",
        "year": "CAST(year(o_orderdate) AS INT)",
        "split": "CASE WHEN year(o_orderdate) <= 1999 THEN 'train' WHEN year(o_orderdate) <= 2000 THEN 'val' ELSE 'test' END",
        "age": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST((o_custkey * 7) % 95 AS DOUBLE) END",
        "sex": "CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'M' WHEN 1 THEN 'F' END",
        "price": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END",
        "kind": "o_orderpriority",
        "status": "o_orderstatus",
        "note": _note,
    }),
    # drug orders: few labels, many brands
    "rx": ("lineitem", {
        "pid": "l_orderkey",
        "line": "l_linenumber",
        "drug": "l_partkey",
        "label": "'c' || CAST(l_partkey % 46 AS STRING)",
        "prescriber": "l_suppkey",
        "qty": "CAST(l_quantity AS DOUBLE)",
        "unit": "CASE CAST(l_linenumber % 5 AS INT) WHEN 0 THEN 'Days' WHEN 1 THEN 'Weeks' WHEN 2 THEN 'Month' WHEN 3 THEN 'Cont.' END",
        "form": "l_returnflag",
        "instruction": "l_linestatus",
        "dose": "CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN '1+0+1' WHEN 1 THEN '1-0-1' WHEN 2 THEN '1 + 0 + 1' WHEN 3 THEN 'SOS ' ELSE '1/2+0+1/2' END",
    }),
    # gold labels and a scored prediction per (row, label)
    "gold": ("lineitem", {"row_id": "l_orderkey", "label": "'c' || CAST(l_partkey % 12 AS STRING)"}),
    "pred": ("lineitem", {
        "row_id": "l_orderkey",
        "label": "'c' || CAST((l_partkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) % 12 AS STRING)",
        "p": "CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 101 AS DOUBLE) / 100.0",
    }),
    # one binary outcome with a probability
    "bin": ("orders", {
        "row_id": "o_orderkey",
        "grp": "CAST(o_custkey % 7 AS INT)",
        "y": "CASE WHEN (o_orderkey * 31 + o_custkey) % 100 < (o_orderkey * 17) % 101 THEN 1 ELSE 0 END",
        "p": "CAST((o_orderkey * 17) % 101 AS DOUBLE) / 100.0",
        "p2": "CAST((o_orderkey * 29 + o_custkey) % 101 AS DOUBLE) / 100.0",
    }),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or a driver table by its own name."""
    if name not in STANDINS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table, cols = STANDINS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in cols.items()))


def with_standins(sql: str, *names: str) -> str:
    """The oracle SQL with its stand-ins as leading common table expressions."""
    heads = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in STANDINS[n][1].items())} FROM {STANDINS[n][0]})" for n in names]
    body = sql.strip()
    if not heads:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(heads)}, {body[5:]}"
    return f"WITH {', '.join(heads)} {body}"


def query(name: str, sql: str | None = None, *names: str):
    """Register a query over frames `names` (passed as DataFrames), and the SQL that checks it."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(frame(spark, sf_dir, n) for n in names))
        if sql:
            ORACLE_SQL[name] = with_standins(sql, *(n for n in names if n in STANDINS))
        return f

    return wrap
