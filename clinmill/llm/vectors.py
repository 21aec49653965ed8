"""What the operators on vectors share: which rows take part, and exact integer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def usable(df: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int]:
    """(rows, length): `keep` and the vector as array<double> `__v`, of the rows that take part.

    Rows whose vector is null or holds null, NaN or infinite entries are left out. Vectors of different lengths
    can't be compared: those of the commonest length (of equally common ones, the longest) take part, the others
    lack entries or have too many and are left out. Without rows the length is 0."""
    rows = df.select(*keep, F.col(vector).cast("array<double>").alias("__v"))
    rows = rows.where(F.col("__v").isNotNull() & F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = rows.groupBy(F.size("__v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    n = lengths[0]["n"] if lengths else 0
    return rows.where(F.size("__v") == n), n


__all__ = ["stored", "usable"]
