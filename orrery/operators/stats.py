"""Statistics of cycles and states, and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MEASURES = ("max", "min", "mean", "sigma")


def _measures(value: str = "value") -> list[Column]:
    return [F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma")]


def segment_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Max, min, mean and population sigma of valid rows (dqf 1 where there is a flag)."""
    kept = rows.where("dqf = 1") if "dqf" in rows.columns else rows
    return kept.groupBy(*keys).agg(*_measures())


def sigma_clip(rows: DataFrame, keys: list[str], limit: float = 6.0) -> DataFrame:
    """Dqf 0 for rows further than limit sigmas from the mean of their group."""
    w = Window.partitionBy(*keys)
    flag = F.col("dqf") if "dqf" in rows.columns else F.lit(1)
    v = F.when(flag == 1, F.col("value"))
    m = rows.withColumns({"_m": F.avg(v).over(w), "_s": F.stddev_pop(v).over(w)})
    return m.withColumn("dqf", F.when((F.col("_s") > 0) & (F.abs(F.col("value") - F.col("_m")) > limit * F.col("_s")), 0).otherwise(flag)).drop("_m", "_s")


def clipped_stats(rows: DataFrame, keys: list[str], limit: float = 6.0) -> DataFrame:
    """Statistics after one round of clipping."""
    return segment_stats(sigma_clip(rows, keys, limit), keys)


def cycle_stats(rows: DataFrame, cycles: DataFrame, gaps: DataFrame, threshold: float, limit: float = 6.0) -> DataFrame:
    """Clipped statistics of each cycle (mnemonic, cycle) whose gap ratio is below the threshold; null elsewhere."""
    good = gaps.where(F.col("gap_ratio") < threshold).select("mnemonic", "cycle")
    stats = clipped_stats(rows, ["mnemonic", "cycle"], limit).join(good, ["mnemonic", "cycle"], "left_semi")
    return cycles.join(stats, ["mnemonic", "cycle"], "left")


def filled(stats: DataFrame) -> DataFrame:
    """A missing cycle takes the one before it, at the head the first after it."""
    known = F.when(F.col("mean").isNotNull(), F.struct(*MEASURES))
    w = Window.partitionBy("mnemonic")
    back, ahead = (w.orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in (F.col("cycle"), F.col("cycle").desc()))
    got = F.coalesce(F.last(known, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(ahead))
    keep = [c for c in stats.columns if c not in MEASURES]
    return stats.withColumn("_s", got).select(*keep, *(F.col(f"_s.{m}").alias(m) for m in MEASURES))


def rolled_up(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Max of max, min of min, mean of mean, mean of sigma. E10: max_sigma gates training."""
    return stats.groupBy(*keys).agg(F.max("max").alias("max"), F.min("min").alias("min"), F.avg("mean").alias("mean"), F.avg("sigma").alias("sigma"), F.max("sigma").alias("max_sigma"))


def model_sigma(rows: DataFrame, keys: list[str], minimum: float = 0.0) -> DataFrame:
    """Root mean square of raw less prediction over valid rows, at least `minimum`."""
    kept = rows.where("dqf = 1") if "dqf" in rows.columns else rows
    rms = F.sqrt(F.avg(F.pow(F.col("value") - F.col("trend"), F.lit(2.0))))
    return kept.groupBy(*keys).agg(F.greatest(F.coalesce(rms, F.lit(0.0)), F.lit(minimum)).alias("sigma"))


def reference_sigma(history: DataFrame, keys: list[str], now: float, days: float = 180.0) -> DataFrame:
    """The larger of the mean positive sigma and the last sigma of the last days; 0 without any."""
    kept = history.where(F.col("time").between(now - days * 86400, now))
    mean = F.avg(F.when(F.col("sigma") > 0, F.col("sigma")))
    return kept.groupBy(*keys).agg(F.coalesce(F.greatest(mean, F.max_by("sigma", "time")), F.lit(0.0)).alias("sigma"))


def change_ratio(sigma: Column, previous: Column) -> Column:
    """Tpc."""
    return F.when((previous > 0) & (sigma < float("inf")), sigma / F.nullif(previous, F.lit(0.0))).otherwise(0.0)


def sibling_ratio(rows: DataFrame, group: list[str], least: int = 30) -> DataFrame:
    """Sigma over the mean sigma of the group, where the group has more than `least` members."""
    w = Window.partitionBy(*group)
    ratio = F.when((F.count(F.lit(1)).over(w) > least) & (F.avg("sigma").over(w) > 0), F.col("sigma") / F.avg("sigma").over(w))
    return rows.withColumn("spc", F.coalesce(ratio, F.lit(0.0)))


def value_counts(rows: DataFrame, keys: list[str], bound: float = 0.0) -> DataFrame:
    """Values and their counts; with a bound, values in time order join the first centre within it, a running mean."""
    if not bound:
        return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("count"))
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        centres: list[list[float]] = []
        for v in pdf.sort_values("time").value:
            hit = next((c for c in centres if abs(c[0] - v) <= bound), None)
            if hit is None:
                centres.append([float(v), 1])
            else:
                hit[1] += 1
                hit[0] += (v - hit[0]) / hit[1]
        out = pd.DataFrame(centres, columns=["value", "count"])
        for k in keys:
            out.insert(0, k, pdf[k].iloc[0])
        return out[[*keys, "value", "count"]]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(fold, f"{kinds}, value double, count long")


def discrete_delta(counts: DataFrame, keys: list[str], warning: float = 1.0, scale: float = 1.5) -> DataFrame:
    """From the three most frequent values the distance that still counts as the same state."""
    top = counts.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("count").desc(), "value"))).where("_n <= 3")
    v = top.groupBy(*keys).agg(*(F.max(F.when(F.col("_n") == i, F.col("value"))).alias(f"v{i}") for i in (1, 2, 3)))
    a, b, c = F.col("v1"), F.col("v2"), F.col("v3")
    d = F.when(b.isNull(), 0.0).when(c.isNotNull() & ((b - a) * (c - a) < 0), F.greatest(F.abs(b - a), F.abs(c - a))).otherwise(F.abs(b - a))
    return v.select(*keys, (d * scale / warning).alias("delta"))


def coefficients(stats: DataFrame, kind: str = "minmax", keys: tuple[str, ...] = ("mnemonic",)) -> DataFrame:
    """E17 minmax, E18 min, E19 max, E20 uniform, E21: offset and scale of each cycle; if any cycle is flat all take the whole range."""
    w = Window.partitionBy(*keys)
    top, low = F.max("max").over(w), F.min("min").over(w)
    flat = F.max(F.when(F.col("max") == F.col("min"), 1).otherwise(0)).over(w) == 1
    whole = F.lit(True) if kind == "uniform" else flat
    hi, lo = F.when(whole, top).otherwise(F.col("max")), F.when(whole, low).otherwise(F.col("min"))
    at = stats.withColumns({"_hi": hi, "_lo": lo})
    span = F.expr("nullif(_hi - _lo, 0)")
    offset = {"min": F.col("_lo"), "max": F.col("_hi")}.get(kind, (F.col("_hi") + F.col("_lo")) / 2)
    return at.withColumns({"offset": offset, "scale": F.coalesce(F.lit(0.9 if kind in ("min", "max") else 1.8) / span, F.lit(0.0))}).drop("_hi", "_lo")


def normalise(value: Column, offset: Column, scale: Column) -> Column:
    """Scaled and clipped to +-0.9."""
    return F.greatest(F.lit(-0.9), F.least(F.lit(0.9), scale * (value - offset)))


def denormalise(value: Column, offset: Column, scale: Column) -> Column:
    """A scale of 0 gives the offset."""
    return F.when(scale == 0, offset).otherwise(value / F.nullif(scale, F.lit(0.0)) + offset)
