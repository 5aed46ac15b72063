"""Zones: half-open intervals (zone_id, start, end) of a flag channel, and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .joins import range_join


def from_flag(rows: DataFrame, *, mindiff: float = 0.0, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """A step up opens at its sample (again: anew), the next step down closes; an open zone ends at the last sample."""
    w = Window.partitionBy("mnemonic").orderBy("time")
    step = F.col("value") - F.lag("value").over(w)
    edge = rows.withColumns({"_up": F.when(step > mindiff, F.col("time")), "_down": F.when(step < -mindiff, F.col("time")), "_last": F.max("time").over(Window.partitionBy("mnemonic"))})
    edges = edge.where(F.col("_up").isNotNull() | F.col("_down").isNotNull())
    nxt = F.lead(F.coalesce(F.col("_down"), -F.col("_up"))).over(w)
    closed = edges.withColumn("_next", nxt).where("_up is not null and (_next is null or _next >= 0)")
    zone = closed.select(F.col("mnemonic").alias("zone_id"), (F.col("_up") - before).alias("start"), (F.coalesce("_next", "_last") + after).alias("end"))
    return coalesce_overlaps(zone)


def coalesce_overlaps(zones: DataFrame) -> DataFrame:
    """Overlapping or touching zones as one; a running maximum of the ends gives the islands."""
    w = Window.partitionBy("zone_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    marked = zones.withColumn("_f", fresh).withColumn("_i", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("zone_id", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_i")


def intersect(a: DataFrame, b: DataFrame, name: str, bucket: float = 86400.0) -> DataFrame:
    """Overlaps of positive length of the zones of a and b; both sides cut into buckets."""
    cut = lambda z, p: z.select(F.col("start").alias(f"s{p}"), F.col("end").alias(f"e{p}"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    both = cut(a, 1).join(cut(b, 2), "_b").select(F.greatest("s1", "s2").alias("start"), F.least("e1", "e2").alias("end")).where("start < end").distinct()
    return both.select(F.lit(name).alias("zone_id"), "start", "end")


def union(zones: DataFrame, ids: list[str], name: str) -> DataFrame:
    """Zones of several ids merged under one name."""
    return coalesce_overlaps(zones.where(F.col("zone_id").isin(ids)).select(F.lit(name).alias("zone_id"), "start", "end"))


def pad(zones: DataFrame, before: float, after: float) -> DataFrame:
    """C05."""
    return coalesce_overlaps(zones.select("zone_id", (F.col("start") - before).alias("start"), (F.col("end") + after).alias("end")))


def at_least(zones: DataFrame, seconds: float) -> DataFrame:
    """C06."""
    return zones.where(F.col("end") - F.col("start") >= seconds)


def overlapping(zones: DataFrame, start: float, end: float) -> DataFrame:
    """Zones that meet [start, end]."""
    return zones.where((F.col("start") <= end) & (F.col("end") >= start))


def expression(zones: DataFrame, text: str, *, before: float = 0.0, after: float = 0.0, start: float | None = None, end: float | None = None) -> DataFrame:
    """C08, C09, C10: 'a|b' merges, 'a$b' intersects; then padding and time filter."""
    if "$" in text:
        a, b = text.split("$")
        out = intersect(zones.where(F.col("zone_id") == a), zones.where(F.col("zone_id") == b), text)
    else:
        out = union(zones, text.split("|"), text)
    if before or after:
        out = pad(out, before, after)
    return out if start is None or end is None else overlapping(out, start, end)


def state_zones(zones: DataFrame, states: list[dict], *, min_duration: float = 900.0, start: float | None = None, end: float | None = None) -> DataFrame:
    """Zones of each state with a flag; maneuver and eclipse states of a least duration; padded once."""
    out = None
    for s in states:
        if not s.get("flag"):
            continue
        z = expression(zones, s["flag"])
        if s["name"] in ("mnvr", "ecl"):
            z = at_least(z, s.get("mindur") or min_duration)
        z = pad(z, s.get("pad", 0.0), s.get("pad", 0.0))
        z = z if start is None or end is None else overlapping(z, start, end)
        z = z.select(F.lit(s["name"]).alias("state"), "start", "end")
        out = z if out is None else out.unionByName(z)
    return out


def complement(zones: DataFrame, start: float, end: float, edge: float = 0.1) -> DataFrame:
    """C11: what lies between the zones in [start, end], ending `edge` before the next zone."""
    merged = coalesce_overlaps(zones.select(F.lit("_").alias("zone_id"), "start", "end")).where((F.col("end") > start) & (F.col("start") < end))
    w = Window.partitionBy("zone_id").orderBy("start")
    gaps = merged.select(F.coalesce(F.lag("end").over(w), F.lit(start)).alias("a"), (F.col("start") - edge).alias("b"))
    tail = merged.agg(F.coalesce(F.max("end"), F.lit(start)).alias("a")).select("a", F.lit(end).alias("b"))
    return gaps.union(tail).where("a < b").select(F.col("a").alias("start"), F.col("b").alias("end"))


def shrink_at_step(zones: DataFrame, rows: DataFrame, zonediff: float, tail: float = 1800.0) -> DataFrame:
    """A zone ends at the first jump over zonediff within its last `tail` seconds."""
    w = Window.partitionBy("mnemonic").orderBy("time")
    jumps = rows.withColumn("_j", F.abs(F.col("value") - F.lag("value").over(w))).where(F.col("_j") > zonediff).select("time")
    late = zones.select("zone_id", F.greatest(F.col("start"), F.col("end") - tail).alias("start"), F.col("end"))
    cut = range_join(jumps, late.withColumnRenamed("zone_id", "_z")).groupBy(F.col("_z").alias("zone_id"), "end").agg(F.min("time").alias("_cut"))
    return zones.join(cut, ["zone_id", "end"], "left").select("zone_id", "start", F.coalesce("_cut", "end").alias("end"))


def touching(zones: DataFrame, start: float, end: float) -> DataFrame:
    """Zones that begin or end in [start, end)."""
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    return zones.where(inside("start") | inside("end"))


def state_of(rows: DataFrame, states: DataFrame, default: str = "default") -> DataFrame:
    """The state whose zone holds a sample; of several the one that began last, else the default."""
    cols = rows.columns
    found = range_join(rows.withColumn("_row", F.monotonically_increasing_id()), states, how="left")
    return found.groupBy("_row", *cols).agg(F.coalesce(F.max_by("state", "start"), F.lit(default)).alias("state")).drop("_row")


def outside(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Samples in no zone."""
    return range_join(rows, zones.select("start", "end"), how="left_anti")


def first_length(zones: DataFrame, session: float) -> DataFrame:
    """Length of the first zone that begins within a day of the session; 0 without one."""
    near = zones.where((F.col("start") >= session) & (F.col("start") <= session + 86400))
    return near.agg(F.coalesce(F.min_by(F.col("end") - F.col("start"), "start"), F.lit(0.0)).alias("duration"))
