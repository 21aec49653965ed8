"""The corpus pipeline: documents in, a cleaned and mixed training corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinmill.llm.common import stored
from clinmill.llm.pipeline import STAGES

#: No SQL: learned scores, MinHash and the character model have none; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage on all that the one before kept; what a stage returns is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
