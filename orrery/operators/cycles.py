"""Session windows, cycle boundaries and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import asof, islands

DAY, YEAR = 86400.0, 31557600.0


def session_window(ref: float, period: float, *, start: float | None = None, long_term: bool = False) -> tuple[float, float]:
    """Around a reference time; long-term: from the mission's start to it."""
    return (start or 0.0, ref) if long_term else (ref - period / 2, ref + period / 2)


def auto_window(kind: str, day: float, hours: float = 48.0, mission: float = 0.0) -> tuple[float, float]:
    """D17 geo, D18 leo (two days), D19 long-term; D39 takes the result as its base."""
    start = day - day % DAY
    return {"geo": (start - hours * 3600, start), "leo": (start - 2 * DAY, start), "longterm": (mission, start)}[kind]


def read_range(start: float, end: float, np: int = 0, period: float = DAY) -> tuple[float, float]:
    """What to read for np patterns of training."""
    return (min(start, end - 2 * np * period), end) if np else (start, end)


def model_query_window(kind: str, t: float, np: int, period: float, delta: float) -> tuple[float, float]:
    """(centre, half-width) of the reference times of input models."""
    if kind == "geo":
        return t - 2 * np * period - delta, delta / 2
    if kind == "leo":
        return (t - 2 * np * period, np * period) if np else (t - period / 2, period / 4)
    return t - period / 2, period / 2


def geo_cycles(spark, start: float, end: float, np: int = 0) -> DataFrame:
    """Daily boundaries (cycle, start, end)."""
    if np >= 1:
        start = end - np * (end - start)
    n = round((end - start) / DAY)
    return spark.range(n).select(F.col("id").alias("cycle"), (F.lit(start) + F.col("id") * DAY).alias("start"), (F.lit(start) + (F.col("id") + 1) * DAY).alias("end"))


def previous_cycles(spark, start: float, np: int = 0) -> DataFrame:
    """2 * max(1, np) daily cycles up to one day before the session's start."""
    n = 2 * max(1, np)
    return geo_cycles(spark, start - DAY - (n - 1) * DAY, start - DAY + DAY)


def yearly_cycles(spark, start: float, end: float) -> DataFrame:
    """D26."""
    n = max(1, -int(-(end - start) // YEAR))
    return spark.range(n).select(F.col("id").alias("cycle"), (F.lit(start) + F.col("id") * YEAR).alias("start"), (F.lit(start) + (F.col("id") + 1) * YEAR).alias("end"))


def cycle_of(t: Column, start: float, period: float = DAY) -> Column:
    """The cycle of a time where cycles are equal: no join."""
    return F.floor((t - start) / period)


def zero_crossings(rows: DataFrame, gap: float | None = None) -> DataFrame:
    """Times, linearly interpolated, at which a channel turns from negative to not negative."""
    keys = ["mnemonic"]
    if gap is not None:
        rows, keys = islands(rows, keys=["mnemonic"], gap=gap), ["mnemonic", "island"]
    w = Window.partitionBy(*keys).orderBy("time")
    d = rows.withColumns({"_v": F.lead("value").over(w), "_t": F.lead("time").over(w)}).where("value < 0 and _v >= 0")
    return d.select(*keys, (F.col("time") - F.col("value") * (F.col("_t") - F.col("time")) / (F.col("_v") - F.col("value"))).alias("time"))


def mean_period(crossings: DataFrame, keys: tuple[str, ...] = ("mnemonic",)) -> DataFrame:
    """Mean step between crossings within segments."""
    w = Window.partitionBy(*keys).orderBy("time")
    d = crossings.withColumn("_d", F.col("time") - F.lag("time").over(w))
    return d.groupBy("mnemonic").agg(F.avg("_d").alias("period"))


def filled_boundaries(crossings: DataFrame, periods: DataFrame, start: float, end: float) -> DataFrame:
    """Crossings with boundaries put into gaps and before and after, one mean period apart."""
    w = Window.partitionBy("mnemonic").orderBy("time")
    rows = crossings.join(periods, "mnemonic").withColumns({"_n": F.lead("time").over(w), "_first": F.min("time").over(Window.partitionBy("mnemonic"))})
    gap = F.col("_n") - F.col("time")
    k = F.when(F.col("_n").isNull(), F.floor((F.lit(end) - F.col("time")) / F.col("period")) + 1).otherwise(F.greatest(F.round(gap / F.col("period")), F.lit(1.0)))
    step = F.when(F.col("_n").isNull(), F.col("period")).otherwise(gap / k)
    inner = rows.withColumns({"_step": step, "_k": F.explode(F.sequence(F.lit(0), k.cast("int") - 1))}).select("mnemonic", (F.col("time") + F.col("_k") * F.col("_step")).alias("time"))
    lead = rows.where("time = _first").withColumn("_m", F.floor((F.col("time") - start) / F.col("period")).cast("int")).where("_m > 0")
    before = lead.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_m")))).select("mnemonic", (F.col("time") - F.col("_k") * F.col("period")).alias("time"))
    return inner.union(before).where(F.col("time") <= end)


def shifted_boundaries(rows: DataFrame, cycles: DataFrame, kind: str, frequency: float, period: float) -> DataFrame:
    """Of each cycle (mnemonic, cycle, start) the time of the max or min, or the middle of the largest step; cycles with too many gaps take the boundary before plus a period."""
    w = Window.partitionBy("mnemonic", "cycle").orderBy("time")
    d = rows.withColumns({"_dt": F.col("time") - F.lag("time").over(w), "_dv": F.abs(F.col("value") - F.lag("value").over(w))})
    pick = {"max": F.max_by("time", F.struct("value", -F.col("time"))), "min": F.min_by("time", F.struct("value", "time")), "diff": F.max_by(F.col("time") - F.col("_dt") / 2, F.struct(F.coalesce("_dv", F.lit(-1.0)), -F.col("time")))}[kind[1:] if kind in ("lmax", "lmin") else kind]
    gaps = F.coalesce(F.sum(F.when(F.col("_dt") > 3 * frequency, F.col("_dt"))), F.lit(0.0)) / period
    got = d.groupBy("mnemonic", "cycle").agg(pick.alias("t"), gaps.alias("_g"), F.count(F.lit(1)).alias("_n"))
    every = cycles.join(got, ["mnemonic", "cycle"], "left").withColumn("_ok", F.when((F.col("_n") >= 2) & (F.col("_g") < 0.1), F.struct("cycle", F.col("t").alias("t"))))
    last = F.last("_ok", ignorenulls=True).over(Window.partitionBy("mnemonic").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("_l", last).where("_l is not null").select("mnemonic", "cycle", (F.col("_l.t") + (F.col("cycle") - F.col("_l.cycle")) * period).alias("time"))


def extended_back(first: Column, data_start: Column, period: float) -> Column:
    """Boundaries from int((first - data_start) / period) periods before the first, in order."""
    n = F.greatest(F.floor((first - data_start) / period).cast("int"), F.lit(0))
    return F.transform(F.sequence(n, F.lit(0)), lambda k: first - k * period)


def extreme_time(rows: DataFrame, kind: str) -> DataFrame:
    """Time of the largest or least value."""
    pick = F.max_by("time", F.struct("value", -F.col("time"))) if kind == "max" else F.min_by("time", F.struct("value", "time"))
    return rows.groupBy("mnemonic").agg(pick.alias("time"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b for b of at least 0; over zero infinite or NaN, as doubles have it, not an error."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(b == 0, a * float("inf"))


def sharpest_time(rows: DataFrame) -> DataFrame:
    """Time of the largest second derivative over three samples at any spacing; the earliest of equal ones.

    Samples of one time go by their value; a slope between them is infinite, or NaN where they are equal, and NaN is largest.
    """
    w = Window.partitionBy("mnemonic").orderBy("time", "value")
    d = rows.withColumns({"a": F.lag("time").over(w), "b": F.lead("time").over(w), "u": F.lag("value").over(w), "v": F.lead("value").over(w)}).where("a is not null and b is not null")
    bend = _ratio(F.col("v") - F.col("value"), F.col("b") - F.col("time")) - _ratio(F.col("value") - F.col("u"), F.col("time") - F.col("a"))
    second = _ratio(2 * bend, F.col("b") - F.col("a"))
    return d.withColumn("s", second).groupBy("mnemonic").agg(F.max_by("time", F.struct("s", -F.col("time"))).alias("time"), F.max("s").alias("second"))


def phase(t: Column, first: float, period: float, last: float | None = None, scale: float = 3600.0) -> Column:
    """Time since the boundary at or before, in units of scale, for equal cycles; times outside wrap by whole periods."""
    return (t - first - F.floor((t - first) / period) * period) / scale


def phase_irregular(rows: DataFrame, boundaries: DataFrame, period: float, scale: float = 3600.0) -> DataFrame:
    """The same for any boundaries (mnemonic, time)."""
    marks = boundaries.select("mnemonic", "time", F.col("time").alias("boundary"))
    got = asof(rows, marks, keys=("mnemonic",), values=["boundary"])
    first = boundaries.groupBy("mnemonic").agg(F.min("time").alias("_first"))
    since = F.coalesce(F.col("boundary"), F.col("_first") - F.ceil((F.col("_first") - F.col("time")) / period) * period)
    d = F.col("time") - since
    return got.join(first, "mnemonic").withColumn("phase", F.when(d > period, d - F.floor(d / period) * period).otherwise(d) / scale).drop("boundary", "_first")


def phase_days(t: Column, ref: float, period: float) -> Column:
    """Days since the reference, moved by one period into range."""
    d = t - ref
    return F.when(d < 0, d + period).when(d > period, d - period).otherwise(d) / DAY


def share_of_interval(t: Column, start: Column, end: Column) -> Column:
    """Place of a time in its interval, 0 to 1."""
    return (t - start) / (end - start)


def training_windows(boundaries: DataFrame, np: int, period: float, offset: int = 0) -> DataFrame:
    """Hopping windows of 2 np cycles, np apart; boundaries past the last continue by the period."""
    n = boundaries.groupBy("mnemonic").agg(F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_list("time")).alias("_b"))
    many = F.greatest(F.lit(1), F.floor((F.col("_c") - offset - 1) / np + 0.5) - 1).cast("int")
    at = lambda i: F.when(i < F.col("_c"), F.get("_b", i)).otherwise(F.get("_b", F.col("_c").cast("int") - 1) + (i - F.col("_c") + 1) * period)
    w = n.withColumn("window", F.explode(F.sequence(F.lit(0), many - 1)))
    return w.select("mnemonic", "window", at((offset + F.col("window") * np).cast("int")).alias("start"), at((offset + F.col("window") * np + 2 * np).cast("int")).alias("end"))


def resume_offset(boundaries: DataFrame, ref: float, patterns: int) -> DataFrame:
    """Index of the boundary nearest to a stored model's reference, plus the patterns if it is not the first."""
    i = F.row_number().over(Window.partitionBy("mnemonic").orderBy("time")) - 1
    best = boundaries.withColumn("_i", i).groupBy("mnemonic").agg(F.min_by("_i", F.struct(F.abs(F.col("time") - ref), "_i")).alias("_i"))
    return best.select("mnemonic", F.when(F.col("_i") > 0, F.col("_i") + patterns).otherwise(0).alias("offset"))


def valid_at(t: Column, ref: Column, np: Column, period: Column, monitoring: bool = False) -> Column:
    """D42."""
    return (t >= ref) & (t <= ref + (3 if monitoring else 2) * np * period)
