"""Models by operating state: split, match with earlier sub-models, reuse, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import linear, stats, zones


def split(rows: DataFrame, states: DataFrame) -> DataFrame:
    """every sample with its state."""
    return zones.state_of(rows, states)


def fit(rows: DataFrame, minimum: float = 0.0) -> DataFrame:
    """F38 with constant sub-models: (mnemonic, state, mu, sigma, n)."""
    mu = linear.constant_fit(rows, ["mnemonic", "state"])
    trended = rows.join(mu, ["mnemonic", "state"]).withColumn("trend", F.col("mu"))
    count = rows.groupBy("mnemonic", "state").agg(F.count(F.lit(1)).alias("n"))
    return mu.join(stats.model_sigma(trended, ["mnemonic", "state"], minimum), ["mnemonic", "state"]).join(count, ["mnemonic", "state"])


def matched(now: DataFrame, before: DataFrame) -> DataFrame:
    """each sub-model with the last earlier one of its state, and tpc."""
    best = before.groupBy("mnemonic", "state").agg(F.max_by("sigma", "ref_time").alias("previous"))
    out = now.join(best, ["mnemonic", "state"], "left")
    return out.withColumn("tpc", stats.change_ratio(F.col("sigma"), F.coalesce("previous", F.lit(0.0))))


def reusable(now: DataFrame, before: DataFrame, session: float, tolerance: float = 20.0) -> DataFrame:
    """sub-models that end before the session and begin within the tolerance of a stored one take its parameters."""
    old = before.select("mnemonic", "state", F.col("start").alias("_s"), F.col("params").alias("_p"))
    same = (F.abs(F.col("start") - F.col("_s")) < tolerance) & (F.col("end") <= session)
    hit = now.join(old, ["mnemonic", "state"], "left").where(F.col("_s").isNull() | same).groupBy(*now.columns).agg(F.min_by("_p", F.abs(F.col("start") - F.col("_s"))).alias("stored"))
    return now.join(hit.select("mnemonic", "state", "start", "stored"), ["mnemonic", "state", "start"], "left")


def needs_refresh(tpc: Column, oc: Column, warning: float = 2.0, error: float = 2.0) -> Column:
    """F41."""
    return (tpc > warning) | (oc > error)


def extended_zones(states: DataFrame, exclusions: DataFrame) -> DataFrame:
    """yesterday's state zones moved by a day, merged with the exclusion zones."""
    moved = states.select(F.lit("x").alias("zone_id"), (F.col("start") + 86400).alias("start"), (F.col("end") + 86400).alias("end"))
    return zones.coalesce_overlaps(moved.union(exclusions.select(F.lit("x"), "start", "end")))


def predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """trend and sigma of the sample's state."""
    return rows.join(models.select("mnemonic", "state", F.col("mu").alias("trend"), "sigma"), ["mnemonic", "state"])
