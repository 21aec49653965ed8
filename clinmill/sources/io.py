"""Sources and sinks: text extracts, Parquet facts, JSON artefacts, JDBC tables, annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_raw(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """CSV with every column as text; only the empty field is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    return spark.read.schema(schema).options(header=True, nullValue="", emptyValue="", multiLine=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_extract(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV, every field quoted, header, UTF-8, ordered inside each file and over the files."""
    df.orderBy(*order).write.mode("overwrite").options(header=True, quoteAll=True, escape='"', encoding="UTF-8", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_fact(df: DataFrame, path: str, columns: list[str], partition_by: list[str] | None = None) -> None:
    w = df.select(*columns).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_fact(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


ANSWER = "icd1 string, no_code string, codability string, preference string, safety1 string, safety2 string, would_differ string"


def read_annotations(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """(annotator, ann_id, answer fields) from files of {annotator, answers: {ann_id: {...}}}, one a file or one a line."""
    raw = spark.read.schema(f"annotator string, answers map<string, struct<{ANSWER.replace(' string', ': string')}>>").option("multiLine", not lines).json(glob)
    return raw.select(F.coalesce("annotator", F.input_file_name()).alias("annotator"), F.explode("answers").alias("ann_id", "a")).select("annotator", "ann_id", "a.*")


def load_table(spark: SparkSession, name: str, url: str | None = None, key: str | None = None, parts: int = 4, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A relation over JDBC, or a catalog table where no url is given; extract joins run in Spark.

    With a whole-number key (as the database spells it, quoted if need be) the relation is read in `parts` ranges of it, each by its own connection and task; one query
    asks for the least and greatest key. The first range also has the rows without a key. Only `columns` are asked for."""
    if not url:
        df = spark.table(name)
        return df.select(*columns) if columns else df
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        df = reader.option("dbtable", name).load()
    else:
        span = reader.option("dbtable", f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {name}) b").load().toDF("lo", "hi").first()
        df = spark.read.jdbc(url, name, predicates=key_ranges(key, span["lo"], span["hi"], parts), properties={k: str(v) for k, v in options.items()})
    return df.select(*columns) if columns else df


def key_ranges(key: str, lo: int | None, hi: int | None, parts: int) -> list[str]:
    """Conditions that part the keys from lo to hi into ranges of about equal width; every row meets one of them."""
    if lo is None or hi is None:
        return ["1 = 1"]
    lo, hi = int(lo), int(hi)
    cuts = sorted({lo + (hi - lo + 1) * k // parts for k in range(1, parts)} - {lo})
    ends = [None, *cuts, None]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        both = " AND ".join(x for x in (f"{key} >= {a}" if a is not None else "", f"{key} < {b}" if b is not None else "") if x) or "1 = 1"
        out.append(both if a is not None or both == "1 = 1" else f"({both}) OR {key} IS NULL")
    return out


def save_table(df: DataFrame, name: str, url: str, **options: str) -> None:
    """A relation written over JDBC, replacing one of that name."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode("overwrite").save()


def require_columns(a: DataFrame, b: DataFrame, extra: tuple[str, ...] = ()) -> None:
    """b has the columns of a and the extra ones, in any order; else ValueError."""
    diff = set(b.columns) ^ (set(a.columns) | set(extra))
    if diff:
        raise ValueError(f"columns differ: {sorted(diff)}")


def dtype_drift(a: DataFrame, b: DataFrame) -> list[tuple[str, str, str]]:
    x, y = dict(a.dtypes), dict(b.dtypes)
    return [(c, x[c], y[c]) for c in x if c in y and x[c] != y[c]]
