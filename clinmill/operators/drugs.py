"""Drug names to molecules and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_name
from .assemble import join_first


def drug_rollup(rx: DataFrame, drug: str, name: str, order: str) -> DataFrame:
    r = rx.where(F.col(drug).isNotNull()).groupBy(drug).agg(F.min_by(name, order).alias("drug_name"), F.count("*").alias("n_orders"))
    return r.withColumn("key", norm_name("drug_name"))


def dup_report(drugs: DataFrame, drug: str) -> DataFrame:
    k = drugs.groupBy("key").agg(F.countDistinct(drug).alias("ids"))
    named = F.col("key") != ""
    return k.agg(F.count_if(named).alias("n_names"), F.count_if(named & (F.col("ids") > 1)).alias("dup_names"), F.coalesce(F.sum(F.when(named & (F.col("ids") > 1), F.col("ids") - 1)), F.lit(0)).alias("redundant_ids"), F.coalesce(F.sum(F.when(~named, F.col("ids"))), F.lit(0)).alias("unnamed_ids"))


def resolve_classes(drugs: DataFrame, curated: DataFrame, catmap: DataFrame, drug: str) -> DataFrame:
    """molecule, drug_class and source: by curated name, else by folded category, else by a mapped id of the same name.

    curated is (key, molecule, drug_class); catmap is (category, molecule, drug_class)."""
    c = curated.select("key", F.col("molecule").alias("__m1"), F.col("drug_class").alias("__c1"))
    m = catmap.select(F.lower(F.trim("category")).alias("__cat"), F.col("molecule").alias("__m2"), F.col("drug_class").alias("__c2"))
    j = drugs.withColumn("__cat", F.lower(F.trim("category"))).join(c, "key", "left").join(m, "__cat", "left")
    first = j.withColumns({"molecule": F.when(F.col("__c1").isNotNull(), F.col("__m1")).otherwise(F.col("__m2")), "drug_class": F.coalesce("__c1", "__c2"), "source": F.when(F.col("__c1").isNotNull(), "curated").when(F.col("__c2").isNotNull(), "rx_category").otherwise("unmapped")})
    known = first.where("drug_class is not null and key <> ''").select("key", F.col("molecule").alias("__m3"), F.col("drug_class").alias("__c3"), "n_orders", F.col(drug).alias("__id"))
    out = join_first(first, known.withColumnRenamed("n_orders", "__n"), "key", F.desc("__n"), "__id")
    fill = F.col("drug_class").isNull() & F.col("__c3").isNotNull() & (F.col("key") != "")
    return out.withColumns({"source": F.when(fill, "name_fold").otherwise(F.col("source")), "molecule": F.when(fill, F.col("__m3")).otherwise(F.col("molecule")), "drug_class": F.coalesce("drug_class", F.when(fill, F.col("__c3")))}).select(drug, "drug_name", "key", "n_orders", "category", "molecule", "drug_class", "source")


def accept_external(drugs: DataFrame, mapping: DataFrame, classes: DataFrame, floor: int) -> DataFrame:
    """Unmapped names take an external class of enough confidence (1 low, 2 medium, 3 high) from the fixed vocabulary."""
    ok = mapping.where(F.col("confidence") >= floor).join(classes.select("drug_class"), "drug_class", "left_semi").select("key", F.col("drug_class").alias("__x"))
    j = drugs.join(ok, "key", "left")
    take = F.col("drug_class").isNull() & F.col("__x").isNotNull()
    return j.withColumns({"source": F.when(take, "external").otherwise(F.col("source")), "drug_class": F.coalesce("drug_class", "__x")}).drop("__x")


def mapper_agreement(curated: DataFrame, mapping: DataFrame) -> DataFrame:
    j = curated.select("key", F.col("drug_class").alias("__g")).join(mapping, "key")
    return j.groupBy("confidence").agg(F.count("*").alias("n"), F.avg((F.col("drug_class") == F.col("__g")).cast("double")).alias("agreement"))


def coverage(drugs: DataFrame) -> DataFrame:
    one = drugs.groupBy("source").agg(F.count("*").alias("n_drugs"), F.sum("n_orders").alias("n_orders"), F.count("drug_class").alias("with_class"), F.count("molecule").alias("with_molecule"))
    return one


def cross_era(rx: DataFrame, levels: dict[str, str], era: str) -> DataFrame:
    """Per level: vocabulary sizes, Jaccard, share of late orders with labels unseen before (strict: unmapped ones
    too) and shared top-10. rx has a column per level and the era column (early or late)."""
    un = reduce(DataFrame.unionByName, (rx.select(F.lit(k).alias("level"), F.col(era).alias("era"), F.col(c).cast("string").alias("label")) for k, c in levels.items()))
    n = un.groupBy("level", "label").agg(F.count_if(F.col("era") == "early").alias("a"), F.count_if(F.col("era") == "late").alias("b"))
    from pyspark.sql import Window

    rank = lambda c: F.row_number().over(Window.partitionBy("level").orderBy(F.desc(c), F.asc_nulls_first("label")))
    n = n.withColumns({"ra": rank("a"), "rb": rank("b")})
    ok, a, b = F.col("label").isNotNull(), F.col("a") > 0, F.col("b") > 0
    s = n.groupBy("level").agg(F.count_if(ok & a).alias("v_early"), F.count_if(ok & b).alias("v_late"), F.try_divide(F.count_if(ok & a & b), F.count_if(ok & (a | b))).alias("jaccard"), F.try_divide(F.sum(F.when(ok & ~a, F.col("b")).otherwise(0)), F.sum("b")).alias("unseen"), F.try_divide(F.sum(F.when(~ok | ~a, F.col("b")).otherwise(0)), F.sum("b")).alias("strict"), F.count_if((F.col("ra") <= 10) & (F.col("rb") <= 10) & a & b).alias("top10_shared"))
    return s


def unfolded(drugs: DataFrame, catmap: DataFrame) -> DataFrame:
    """Categories that the fold table lacks, by orders."""
    d = drugs.where("category is not null and category <> ''").withColumn("__cat", F.lower(F.trim("category")))
    return d.join(catmap.select(F.lower(F.trim("category")).alias("__cat")), "__cat", "left_anti").groupBy("category").agg(F.sum("n_orders").alias("n_orders"))
