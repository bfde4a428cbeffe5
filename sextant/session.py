"""Spark session settings used by the library's own entry points."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app_name: str = "sextant", **extra: str) -> SparkSession:
    """Session with the settings the operators were tuned for.

    The master, memory and partition counts are left to spark-submit; only
    semantics (time zone, identifier quoting) and adaptive execution are set.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
