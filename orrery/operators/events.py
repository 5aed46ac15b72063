"""Outliers folded into events, and events of channels into events of the whole satellite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def from_outliers(rows: DataFrame, frequency: Column | float, scale: float = 1.0) -> DataFrame:
    """Outliers closer than the frequency form an event; its value is the trapezoid integral of |diff| / scale."""
    w = Window.partitionBy("mnemonic", "state").orderBy("time")
    f = rows.withColumns({"_f": F.lit(frequency) if not isinstance(frequency, Column) else frequency, "_n": F.abs("diff") / scale})
    d = f.withColumns({"_dt": F.col("time") - F.lag("time").over(w), "_p": F.lag("_n").over(w)})
    d = d.withColumn("_new", F.when(F.col("_dt") < F.col("_f"), 0).otherwise(1)).withColumn("_e", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    area = F.sum(F.when(F.col("_new") == 0, 0.5 * (F.col("_p") + F.col("_n")) * F.col("_dt")).otherwise(0.0))
    out = d.groupBy("mnemonic", "state", "_e").agg(area.alias("event_value"), F.min("time").alias("event_start"), F.max("time").alias("event_end"))
    return out.select(F.col("mnemonic").alias("name"), F.lit("outlier").alias("event_type"), F.col("state").alias("event_state"), "event_value", "event_start", "event_end")


def coalesced(events: DataFrame, join_time: float, threshold: float) -> DataFrame:
    """In order of start, an event within join_time of the last kept one merges if both values exceed the threshold; other events stay if theirs does; the first always stays. An ordered fold over the events of one channel."""
    row = "struct<event_start:double,event_end:double,event_value:double>"
    items = F.array_sort(F.collect_list(F.struct("event_start", "event_end", "event_value")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = ((x["event_start"] >= last["event_start"]) & (x["event_start"] <= last["event_end"])) | (F.abs(x["event_start"] - last["event_start"]) < join_time) | (F.abs(x["event_start"] - last["event_end"]) < join_time)
        both = (x["event_value"] > threshold) & (last["event_value"] > threshold)
        one = F.struct(F.least(last["event_start"], x["event_start"]).alias("event_start"), F.greatest(last["event_end"], x["event_end"]).alias("event_end"), (last["event_value"] + x["event_value"]).alias("event_value"))
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))
        return F.when(F.size(acc) == 0, F.array(x)).when(near & both, merged).when(~near & (x["event_value"] > threshold), F.concat(acc, F.array(x))).otherwise(acc)

    folded = events.groupBy("name", "event_state").agg(F.aggregate(items, F.array().cast(f"array<{row}>"), step).alias("_e"))
    return folded.select("name", "event_state", F.inline("_e"))


def value_in_range(events: DataFrame, start: float, end: float, state: str | None = None) -> DataFrame:
    """Summed value of the events that meet [start, end]."""
    hit = (F.col("event_end") >= start) & (F.col("event_start") <= end)
    if state is not None:
        hit &= F.col("event_state") == state
    return events.groupBy("name").agg(F.coalesce(F.sum(F.when(hit, F.col("event_value"))), F.lit(0.0)).alias("event_value"))


def session_events(events: DataFrame, cutoff: float) -> DataFrame:
    """H09."""
    return events.where((F.col("event_value") > 0) & (F.col("event_start") > cutoff))


def satellite_events(events: DataFrame, *, cutoff: float, join_time: float, least: float, long: float) -> tuple[DataFrame, DataFrame]:
    """(joined, long): events over `long` seconds apart; of the others those above `least`, joined where they meet or come within join_time of all before them in their event. One row an event, subsystem and channel."""
    kept = events.where(F.col("event_end") > cutoff)
    duration = F.col("event_end") - F.col("event_start")
    far = kept.where(duration > long)
    w = Window.partitionBy("satellite").orderBy("event_start", "event_end", "name")
    rest = kept.where((duration <= long) & (F.col("event_value") > least))
    reach = F.max("event_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = rest.withColumn("_new", F.when(reach.isNull() | (F.col("event_start") - reach >= join_time), 1).otherwise(0))
    d = d.withColumn("event_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    leaf = d.groupBy("satellite", "event_id", "subsystem", "name").agg(F.sum("event_value").alias("value"), F.min("event_start").alias("start"), F.max("event_end").alias("end"))
    return leaf, far


def tree_values(leaf: DataFrame) -> DataFrame:
    """Root sum of squares at subsystem and satellite, Q26: of the final leaf values."""
    sub = leaf.groupBy("satellite", "event_id", "subsystem").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))
    top = leaf.groupBy("satellite", "event_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value")).select("satellite", "event_id", F.lit(None).cast("string").alias("subsystem"), "value")
    return sub.unionByName(top)


def rendered(name: Column, start: Column, end: Column, value: Column) -> Column:
    """H16."""
    from ..functions.timefn import format_long

    return F.concat_ws(" ", name, format_long(start), format_long(end), F.format_string("%.3f", value))
