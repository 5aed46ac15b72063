"""Spark session with the engine's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "orrery", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; everything else is the cluster's to choose."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
