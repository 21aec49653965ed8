"""Registered queries over the reference's operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_clean, q_extra, q_more, q_profile, q_score, q_text  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label concentration: the share of all orders that the k most prescribed drugs hold."""
    return QUERIES["wn02_concentration"](spark, sf_dir)
