"""The stages of corpus_pipeline.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, mixing, ngram_join, pii, toxicity
from .common import read


def no_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return ngram_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark passage."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of personal data in place of each span."""
    return pii.redact(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate the documents to the target weights of their sources and shuffle."""
    return mixing.mixed(docs)


STAGES = [("toxicity", no_toxic), ("near_duplicates", one_of_each), ("decontamination", no_benchmark), ("personal_data", no_personal_data), ("mixing", to_weights)]
