"""Exact quantiles of continuous columns by narrowing ranges: no task holds more than a fixed number of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Ranges that a range is cut into in a round, and values that are ranked in one place at most.
CUTS, FEW = 1024, 2048


def quantiles(df: DataFrame, want: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """The linearly interpolated quantiles of numeric columns, exact; None for a column without values.

    Nulls and NaN are no values. A round counts the values of each range that holds a wanted rank, in CUTS equal cuts
    of it, with the least and greatest value of each cut; of these only the cut with the rank goes on, from its own least
    to its own greatest value. A cut of one value, or of FEW values at most, ends the search: these few are ranked.
    Tasks send counts by cut, at most CUTS + 1 a range, and all columns share a round. Values are
    written once and read in each round."""
    cols = list(want)
    if not cols:
        return {}
    value = lambda k, c: F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v"))
    rows = df.select(F.explode(F.array(*(value(k, c) for k, c in enumerate(cols)))).alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = stored(rows)
    span = {r["c"]: r for r in rows.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    ranks = {(k, r) for k, c in enumerate(cols) if k in span for p in want[c] for r in _around(p, span[k]["n"])}
    found: dict[tuple[int, int], float] = {}
    # open ranges: (column, least, greatest value, values in it, values below it) and the ranks sought there
    todo = _settle([(k, s["lo"], s["hi"], s["n"], 0) for k, s in span.items()], ranks, found)
    while wide := [x for x in todo if x[3] > FEW]:
        todo = [x for x in todo if x[3] <= FEW] + _settle(_cut(rows, wide, ranks), ranks, found)
    if todo:
        few = _table(rows, todo).join(rows, "c").where("v between lo and hi").groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("v"))  # of FEW values each
        for r in few.collect():
            k, _, _, _, below = todo[r["i"]]
            found |= {(k, x): r["v"][x - below] for c, x in ranks if c == k and below <= x < below + len(r["v"])}
    return {c: [_between(p, span[k]["n"], lambda r, k=k: found[k, r]) if k in span else None for p in want[c]] for k, c in enumerate(cols)}


def _around(p: float, n: int) -> tuple[int, int]:
    return math.floor(p * (n - 1)), math.ceil(p * (n - 1))


def _between(p: float, n: int, at) -> float:
    """As Spark's percentile interpolates."""
    where, (lo, hi) = p * (n - 1), _around(p, n)
    return at(lo) if lo == hi or at(lo) == at(hi) else (hi - where) * at(lo) + (where - lo) * at(hi)


def _settle(ranges: list[tuple], ranks: set, found: dict) -> list[tuple]:
    """Ranges that still hold a wanted rank; those of one value settle theirs."""
    left = []
    for x in ranges:
        k, lo, hi, n, below = x
        mine = [(c, r) for c, r in ranks if c == k and below <= r < below + n]
        if mine and lo == hi:
            found |= dict.fromkeys(mine, lo)
        elif mine:
            left.append(x)
    return left


def _table(rows: DataFrame, ranges: list[tuple]) -> DataFrame:
    """The open ranges, at most one for each wanted rank, for a broadcast."""
    data = [(i, k, lo, hi, below) for i, (k, lo, hi, _, below) in enumerate(ranges)]
    return F.broadcast(rows.sparkSession.createDataFrame(data, "i int, c int, lo double, hi double, below long"))


def _cut(rows: DataFrame, ranges: list[tuple], ranks: set) -> list[tuple]:
    """The cuts of the ranges that hold wanted ranks, as ranges.

    A cut's number rises with the value, whatever the rounding; the ends of a range get different numbers, so each
    round parts them. Halves keep differences finite, and infinities have numbers of their own."""
    half = lambda c: F.col(c) / 2
    inf = float("inf")
    lo, hi = F.greatest("lo", F.lit(-1.7e308)), F.least("hi", F.lit(1.7e308))
    at = F.when(F.col("v") == inf, CUTS + 1).when(F.col("v") == -inf, -1).otherwise(F.floor((half("v") - lo / 2) / (hi / 2 - lo / 2) * CUTS))
    cut = _table(rows, ranges).join(rows, "c").where("v between lo and hi").groupBy("i", "c", "below", at.alias("cut")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = Window.partitionBy("i").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # over the cuts of a range
    cut = cut.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.broadcast(rows.sparkSession.createDataFrame(sorted(ranks), "c int, r long"))
    held = cut.join(wanted, (cut["c"] == wanted["c"]) & (wanted["r"] >= cut["below"]) & (wanted["r"] < cut["below"] + cut["n"])).select(cut["c"], "lo", "hi", "n", "below").distinct()
    return [(r["c"], r["lo"], r["hi"], r["n"], r["below"]) for r in held.collect()]
