"""Connected components as joins and grouped minima; no component is ever held in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each node of edges (src, dst); comp is the smallest id of the component.

    Each round links every node to its smallest neighbour's label (large star) and then jumps to
    that label's own label, so a chain shrinks by about half a round; rounds go on until no label moves.
    Rounds are written to the shared folder, where the one before is deleted; only one row a round
    reaches the driver.
    """
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct())
    label = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")).select("id", F.least("id", "low").alias("comp"), F.lit(True).alias("moved"))
    label = stored(label)
    while not label.where("moved").isEmpty():
        near = both.join(label.select(F.col("id").alias("dst"), F.col("comp").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        step = label.join(near, "id").select("id", "comp", F.least("comp", "c").alias("next"))
        # a label's own node may carry a smaller label already, or learn one from its members
        told = step.groupBy(F.col("comp").alias("id")).agg(F.min("next").alias("told"))
        step = stored(step.join(told, "id", "left").select("id", "comp", F.least("next", F.coalesce("told", "next")).alias("next")))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = stored(step.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("comp"), (F.least("next", F.coalesce("far", "next")) != F.col("comp")).alias("moved")))
        dropped(label, step)
        label = new
    dropped(both)
    return label.select("id", "comp")
