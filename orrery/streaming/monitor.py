"""Monitoring of a stream against the latest models; retraining stays a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.monitor import outliers


def judged(stream: DataFrame, models: DataFrame, limit: float = 3.0, ocscale: float = 1.0) -> DataFrame:
    """Outliers of a stream (mnemonic, ts, value); models (mnemonic, trend, sigma) are the static side of the join."""
    rows = stream.withColumn("time", F.unix_micros("ts") / 1e6).join(models, "mnemonic")
    return outliers(rows, limit, ocscale=ocscale)


def event_windows(found: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events as session windows of outliers: bounded state, late rows up to the watermark."""
    window = F.session_window("ts", gap)
    return found.withWatermark("ts", late).groupBy("mnemonic", window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("diff")).alias("peak")).select("mnemonic", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def start(found: DataFrame, folder: str, checkpoint: str):
    """Appends outliers to a Parquet table, exactly once by the checkpoint."""
    return found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
