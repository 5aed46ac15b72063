"""Outliers: samples further from the model than a multiple of its sigma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .zones import outside


def outliers(rows: DataFrame, limit: Column | float, *, ocscale: float = 1.0, zones: DataFrame | None = None) -> DataFrame:
    """Rows (mnemonic, time, value, trend, sigma) with |trend - value| > limit sigma; diff is the excess in sigmas."""
    if zones is not None:
        rows = outside(rows, zones)
    d = F.col("trend") - F.col("value")
    bar = limit * F.col("sigma")
    hit = rows.where((F.col("sigma") > 0) & (F.abs(d) > bar))
    return hit.withColumns({"limit": F.col("trend") - bar * F.signum(d), "diff": (d - bar * F.signum(d)) / (F.col("sigma") * ocscale)})


def flagged(rows: DataFrame, limit: Column | float) -> DataFrame:
    """Quality flags after monitoring."""
    return rows.withColumn("dqf", F.when((F.col("sigma") > 0) & (F.abs(F.col("trend") - F.col("value")) > limit * F.col("sigma")), 0).otherwise(F.col("dqf") if "dqf" in rows.columns else F.lit(1)))


def pre_flag(rows: DataFrame, limit: Column | float, ratio: float) -> DataFrame:
    """Flags by an earlier model; where too many rows fail, the model is stale and no row is flagged."""
    f = flagged(rows, limit)
    w = Window.partitionBy("mnemonic")
    bad = F.sum(F.when(F.col("dqf") == 0, 1).otherwise(0)).over(w) / F.count(F.lit(1)).over(w)
    return f.withColumn("dqf", F.when(bad > ratio, 1).otherwise(F.col("dqf")))
