"""Session defaults: UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "clinmill", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
