"""Telemetry: (mnemonic STRING, time DOUBLE epoch seconds, value DOUBLE)."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SCHEMA = "mnemonic string, time double, value double"


class TelemetrySource(Protocol):
    """What gives the samples of channels in a time range."""

    def get_data(self, mnemonics: list[str], start: float, end: float) -> DataFrame: ...


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


class EventTableSource:
    """The events table as telemetry: one channel for each event type."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def all(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/events.parquet")
        return rows.select(F.col("event_type").alias("mnemonic"), seconds(F.col("ts")).alias("time"), "value")

    def get_data(self, mnemonics: list[str], start: float, end: float) -> DataFrame:
        """Range scan, both ends inclusive; filters reach the Parquet scan on the channel."""
        return self.all().where(F.col("mnemonic").isin(mnemonics) & F.col("time").between(start, end))


def decode_series(blobs: DataFrame) -> DataFrame:
    """(mnemonic, start, values ARRAY) -> one sample a second."""
    return blobs.select("mnemonic", "start", F.posexplode("values").alias("at", "value")).select("mnemonic", (F.col("start") + F.col("at")).cast("double").alias("time"), F.col("value").cast("double").alias("value"))


def packetise(samples: DataFrame) -> DataFrame:
    """Samples of a channel in time order as arrays, with count and bounds."""
    packed = F.array_sort(F.collect_list(F.struct("time", "value")))
    return samples.groupBy("mnemonic").agg(packed.alias("p")).select("mnemonic", F.col("p.time").alias("times"), F.col("p.value").alias("values"))


def interpolated(rows: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Values of rows (keys, time, value) at the grid's times, linear between neighbours, clamped outside.

    One union and two windows on the keys; no as-of join and no collected series.
    """
    both = rows.select(*keys, "time", "value", F.lit(0).alias("asked")).unionByName(grid.select(*keys, "time", F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked")))
    known = F.when(F.col("value").isNotNull(), F.struct("time", "value"))
    back = Window.partitionBy(*keys).orderBy("time", "asked").rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back in falling order: such a frame grows row by row, one to the end is evaluated anew for each
    ahead = Window.partitionBy(*keys).orderBy(F.col("time").desc(), "asked").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"a": F.last(known, ignorenulls=True).over(back), "b": F.last(known, ignorenulls=True).over(ahead)}).where("asked = 1")
    share = (F.col("time") - F.col("a.time")) / (F.col("b.time") - F.col("a.time"))
    line = F.when(F.col("a").isNull(), F.col("b.value")).when(F.col("b").isNull() | (F.col("a.time") == F.col("b.time")), F.col("a.value")).otherwise(F.col("a.value") + share * (F.col("b.value") - F.col("a.value")))
    return near.select(*keys, "time", line.alias("value"))


def resample(samples: DataFrame) -> DataFrame:
    """Regular grid from the first sample at max(1, round(mean spacing)) seconds, linearly interpolated."""
    span = samples.groupBy("mnemonic").agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.count(F.lit(1)).alias("n"))
    step = F.greatest(F.lit(1.0), F.round((F.col("t1") - F.col("t0")) / F.col("n")))
    shape = span.withColumn("step", step).withColumn("m", F.ceil((F.col("t1") - F.col("t0")) / F.col("step")).cast("int")).where("m > 0")
    grid = shape.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("mnemonic", (F.col("t0") + F.col("k") * F.col("step")).alias("time"))
    return interpolated(samples, grid, ["mnemonic"])


def aggregate_window(samples: DataFrame, every: float = 2.0) -> DataFrame:
    """Mean of each window of `every` seconds, labelled by its end; empty windows give no row."""
    end = (F.floor(F.col("time") / every) + 1) * every
    return samples.groupBy("mnemonic", end.cast("double").alias("time")).agg(F.avg("value").alias("value"))
