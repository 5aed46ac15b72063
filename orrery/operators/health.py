"""Health status of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Normal, warning, error, failed.
NORMAL, WARNING, ERROR, FAILED = 1, 2, 3, 4


def capped(metric: Column, warning: float, known: Column) -> Column:
    """A metric of a known long event, short eclipse or yaw flip stays just below the warning limit."""
    return F.when(known, F.least(metric, F.lit(warning - 0.1))).otherwise(metric)


def hybrid_metric(tpc: Column, state: Column, eclipse_rule: Column) -> Column:
    """Other states than the default count half, outside the eclipse rule."""
    return F.when((state != "default") & ~eclipse_rule, tpc / 2).otherwise(tpc)


def active(ref_time: Column, cutoff: float, state: Column) -> Column:
    """Models that the status reports."""
    return (ref_time > cutoff) | state.isin("charge", "default")


def status_code(tpc: Column, oc: Column, noise: Column, *, tpc_limits: tuple[float, float] = (2.0, 3.0), oc_limits: tuple[float, float] = (1.0, 2.0), scale: Column | float = 1.0) -> Column:
    """Error over either error limit, else warning over either warning limit; noise channels by tpc alone."""
    t, o = tpc / scale, F.when(noise, F.lit(0.0)).otherwise(oc / scale)
    return F.when((t > tpc_limits[1]) | (o > oc_limits[1]), ERROR).when((t > tpc_limits[0]) | (o > oc_limits[0]), WARNING).otherwise(NORMAL)


def evaluate(models: DataFrame, oc: DataFrame, stats: DataFrame, noise: DataFrame, *, time: float, failed: DataFrame | None = None, **limits) -> DataFrame:
    """One status row a channel and state; channels that failed have code 4 and zeros."""
    rows = models.join(oc.select("mnemonic", "oc_value"), "mnemonic", "left").join(noise.select(F.col("name").alias("mnemonic"), F.lit(True).alias("_noise")), "mnemonic", "left")
    rows = rows.join(stats.select("mnemonic", "max", "min", "mean", F.col("sigma").alias("stat_sigma")), "mnemonic", "left")
    oc_value = F.coalesce("oc_value", F.lit(0.0))
    out = rows.select("mnemonic", "state", F.lit(float(time)).alias("time"), status_code(F.col("tpc"), oc_value, F.coalesce("_noise", F.lit(False)), **limits).cast("double").alias("code"), "tpc", oc_value.alias("oc_value"), F.lit(0.0).alias("derivative"), "sigma", "max", "min", "mean", "stat_sigma")
    return out if failed is None else out.unionByName(failed_status(failed, time))


def failed_status(channels: DataFrame, time: float) -> DataFrame:
    """J06."""
    zero = [F.lit(0.0).alias(c) for c in ("tpc", "oc_value", "derivative", "sigma", "max", "min", "mean", "stat_sigma")]
    return channels.select("mnemonic", F.lit("default").alias("state"), F.lit(float(time)).alias("time"), F.lit(float(FAILED)).alias("code"), *zero)


def tpc_events(status: DataFrame, start: float, end: float, bar: float = 2.0) -> DataFrame:
    """An event over the session for channels that are not normal and whose tpc exceeds the limit."""
    return status.where((F.col("code") > NORMAL) & (F.col("tpc") > bar)).select(F.col("mnemonic").alias("name"), F.lit("tpc").alias("event_type"), F.col("state").alias("event_state"), F.col("tpc").alias("event_value"), F.lit(float(start)).alias("event_start"), F.lit(float(end)).alias("event_end"))
