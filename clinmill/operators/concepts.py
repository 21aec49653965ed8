"""Concepts from phrases: similarity groups with a support floor, and their assignment to spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .retrieve import block_topk, similarity_groups


def induce_concepts(phrases: DataFrame, most: int = 4000, tau: float = 0.70, support: int = 25) -> DataFrame:
    """(phrase, concept, label, support, centroid) from (phrase, freq, vec): the `most` frequent phrases (a
    parameter of the method) are linked at cosine tau and more, linked groups with enough support become concepts
    named by their most frequent phrase, with a frequency-weighted centroid."""
    top = stored(phrases.orderBy(F.desc("freq"), "phrase").limit(most))
    lab = similarity_groups(top.select(F.col("phrase").alias("id"), "vec"), tau).select(F.col("id").alias("phrase"), F.col("comp").alias("root"))
    g = lab.join(top, "phrase")
    name = g.groupBy("root").agg(F.sum("freq").alias("support"), F.max_by("phrase", F.struct("freq", "phrase")).alias("label"))
    unit = g.select("root", "freq", F.posexplode("vec").alias("i", "v"))
    cent = unit.groupBy("root", "i").agg((F.sum(F.col("v") * F.col("freq")) / F.sum("freq")).alias("v")).groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))
    kept = name.where(F.col("support") >= support).withColumn("concept", F.row_number().over(Window.orderBy(F.desc("support"), "label")) - 1)  # over concepts
    return g.join(kept, "root").join(cent, "root").select("phrase", "concept", "label", "support", "centroid")


def assign_concepts(spans: DataFrame, concepts: DataFrame, tau: float = 0.72) -> DataFrame:
    """(key, concept, how) for (key, phrase, vec): the phrase's own concept, else the nearest centroid at tau or more."""
    own = spans.join(concepts.select("phrase", "concept"), "phrase").select("key", "concept", F.lit("exact").alias("how"))
    rest = spans.join(concepts.select("phrase"), "phrase", "left_anti")
    cent = concepts.select(F.col("concept").alias("rid"), F.col("centroid").alias("vec")).dropDuplicates(["rid"])  # a row per concept
    near = block_topk(rest.select(F.col("key").alias("qid"), "vec"), cent, 1, 1.0).where(F.col("score") >= tau)
    return own.unionByName(near.select(F.col("qid").alias("key"), F.col("rid").alias("concept"), F.lit("centroid").alias("how")))
