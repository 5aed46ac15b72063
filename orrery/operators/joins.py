"""Joins on time: points in intervals, and the last or next row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def range_join(points: DataFrame, intervals: DataFrame, *, keys: tuple[str, ...] = (), bucket: float = 86400.0, how: str = "inner", time: str = "time", start: str = "start", end: str = "end") -> DataFrame:
    """Points with start <= time < end. Intervals are cut into buckets, so this is an equi-join; each point has one bucket."""
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    marked = points.withColumn("_bucket", F.floor(F.col(time) / bucket))
    right = cut.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate((*keys, "_bucket"))), *(c for c in intervals.columns if c not in keys))
    on = (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    for i, c in enumerate((*keys, "_bucket")):
        on &= F.col(c) == F.col(f"_k{i}")
    out = marked.join(right, on, how)
    drop = ["_bucket", *(f"_k{i}" for i in range(len(keys) + 1))]
    return out.drop(*drop)


def asof(points: DataFrame, facts: DataFrame, *, keys: tuple[str, ...], values: list[str], at: str = "time", ahead: bool = False, time: str = "time") -> DataFrame:
    """Each point with the last fact at or before it (ahead: the next after it)."""
    rest = [c for c in points.columns if c not in (*keys, time)]
    facts = facts.select(*keys, F.col(at).alias(time), F.struct(*(F.col(v) for v in values)).alias("_fact"))
    both = points.withColumns({"_fact": F.lit(None).cast(facts.schema["_fact"].dataType), "_point": F.lit(1)}).unionByName(facts.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    if ahead:
        pick = F.last("_fact", ignorenulls=True).over(w.orderBy(F.col(time).desc(), F.col("_point").desc()).rowsBetween(Window.unboundedPreceding, 0))
    else:
        pick = F.last("_fact", ignorenulls=True).over(w.orderBy(F.col(time), F.col("_point")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_got", pick).where("_point = 1").select(*keys, time, *rest, *(F.col(f"_got.{v}").alias(v) for v in values))


def islands(rows: DataFrame, *, keys: list[str], gap: float, time: str = "time") -> DataFrame:
    """Rows with `island`, a number that grows where the step from the row before exceeds gap."""
    w = Window.partitionBy(*keys).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
