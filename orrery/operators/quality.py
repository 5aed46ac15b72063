"""Cleaning, alignment and quality flags of samples (mnemonic, time, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def _by_time():
    return Window.partitionBy("mnemonic").orderBy("time")


def sort_unique(rows: DataFrame) -> DataFrame:
    """One sample a time and channel, the least value of them."""
    return rows.groupBy("mnemonic", "time").agg(F.min("value").alias("value"))


def time_subset(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Start <= time < end."""
    return rows.where((F.col("time") >= start) & (F.col("time") < end))


def index_subset(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows first..last (from 0, inclusive) of each channel in time order."""
    return rows.withColumn("index", F.row_number().over(_by_time()) - 1).where(F.col("index").between(first, last))


def gap_ratio(rows: DataFrame, frequency: Column, period: Column | float, factor: float = 6.0) -> DataFrame:
    """Share of the period in steps longer than factor times the frequency."""
    step = rows.withColumns({"_d": F.col("time") - F.lag("time").over(_by_time()), "_f": frequency})
    long = F.sum(F.when(F.col("_d") > factor * F.col("_f"), F.col("_d")))
    return step.groupBy("mnemonic").agg((F.coalesce(long, F.lit(0.0)) / period).alias("gap_ratio"), F.count(F.lit(1)).alias("n"))


def finite(rows: DataFrame, column: str = "value") -> DataFrame:
    """B06."""
    v = F.col(column)
    return rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def output_delta(rows: DataFrame, scale: float = float("inf")) -> DataFrame:
    """Dv / dt at the later sample, where |dv| < scale and dt is not 0; the first sample's dv is 0 over no time."""
    d = rows.withColumns({"dv": F.col("value") - F.lag("value").over(_by_time()), "dt": F.col("time") - F.lag("time").over(_by_time())})
    return d.where((F.abs("dv") < scale) & (F.col("dt") != 0)).select("mnemonic", "time", (F.col("dv") / F.col("dt")).alias("value"))


def output_delta_near(rows: DataFrame, maxdiff: float, frequency: Column) -> DataFrame:
    """Dv / dt (0 where dt is 0) of steps with |dv| <= maxdiff and dt <= 3 frequencies."""
    d = rows.withColumns({"dv": F.col("value") - F.lag("value").over(_by_time()), "dt": F.col("time") - F.lag("time").over(_by_time()), "_f": frequency})
    kept = d.where((F.abs("dv") <= maxdiff) & (F.col("dt") <= 3 * F.col("_f")))
    return kept.select("mnemonic", "time", F.when(F.col("dt") == 0, 0.0).otherwise(F.col("dv") / F.expr("nullif(dt, 0)")).alias("value"))


def input_derivative(rows: DataFrame, x: str, maxdiff: float, frequency: Column, keep_x: bool = False) -> DataFrame:
    """Central difference of x over two steps; the target is the middle sample, the time the last one's."""
    w = _by_time()
    d = rows.withColumns({"dx": F.col(x) - F.lag(x, 2).over(w), "dt": F.col("time") - F.lag("time", 2).over(w), "raw": F.lag("value", 1).over(w), "_f": frequency})
    kept = d.where((F.abs("dx") <= maxdiff) & (F.col("dt") <= 3 * F.col("_f")) & (F.col("dt") > 0))
    return kept.select("mnemonic", "time", (F.col("dx") / F.col("dt")).alias("derivative"), *([x] if keep_x else []), "raw")


def derive(rows: DataFrame, option: str, **how) -> DataFrame:
    """Rows as they are, dr: derivative of the output, indr: of the input, mixed: input and its derivative."""
    if option == "dr":
        return output_delta(rows, how.get("scale", float("inf")))
    if option in ("indr", "mixed"):
        return input_derivative(rows, how["x"], how["maxdiff"], how["frequency"], keep_x=option == "mixed")
    return rows


def counter_rate(rows: DataFrame, sample_period: float = 80.0) -> DataFrame:
    """First value of each window, its step from the window before over a tenth of the period, 0 at a reset."""
    first = rows.groupBy("mnemonic", (F.floor(F.col("time") / sample_period) * sample_period).cast("double").alias("window")).agg(F.min_by("value", "time").alias("value"))
    d = first.withColumn("_d", F.col("value") - F.lag("value").over(Window.partitionBy("mnemonic").orderBy("window"))).where("_d is not null")
    return d.select("mnemonic", F.col("window").alias("time"), F.when(F.col("_d") < 0, 0.0).otherwise(F.col("_d") / (sample_period / 10)).alias("value"))


def largest_triangles(t: np.ndarray, v: np.ndarray, n_out: int) -> np.ndarray:
    """Indices of n_out points that keep a series' shape: of each bucket the point of the largest triangle."""
    n = len(t)
    if n <= n_out or n_out < 3:
        return np.arange(n) if n <= n_out else np.array([0, n - 1][:n_out])
    edges = np.floor(np.linspace(1, n - 1, n_out - 1)).astype(int)
    kept = [0]
    for i in range(n_out - 2):
        lo, hi = edges[i], max(edges[i] + 1, edges[i + 1])
        after = slice(hi, edges[i + 2] if i + 2 < len(edges) else n) if i + 2 < len(edges) else slice(n - 1, n)
        ct, cv = t[after].mean(), v[after].mean()
        a = kept[-1]
        area = np.abs((t[a] - ct) * (v[lo:hi] - v[a]) - (t[a] - t[lo:hi]) * (cv - v[a]))
        kept.append(lo + int(np.argmax(area)))
    return np.array([*kept, n - 1])


def downsample(rows: DataFrame, n_out: int) -> DataFrame:
    """Each channel thinned to n_out shape-keeping samples. Order-dependent, so a function of the channel."""

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        return pdf.iloc[largest_triangles(pdf.time.to_numpy(), pdf.value.to_numpy(), n_out)]

    return rows.select("mnemonic", "time", "value").groupBy("mnemonic").applyInPandas(thin, "mnemonic string, time double, value double")


def correlated(rows: DataFrame, columns: list[str], bar: float = 0.99) -> list[str]:
    """Columns whose correlation with an earlier one exceeds bar; one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(*(F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs)).first() if pairs else {}
    return sorted({b for a, b in pairs if got[f"{a}:{b}"] is not None and abs(got[f"{a}:{b}"]) > bar}, key=columns.index)


def write_back(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Quality flags of a part, by channel and time, over those of the whole."""
    part = flags.select("mnemonic", "time", F.col("dqf").alias("_dqf"))
    return rows.join(part, ["mnemonic", "time"], "left").withColumn("dqf", F.coalesce("_dqf", "dqf")).drop("_dqf")


def limit_flags(rows: DataFrame, high: float = 0.0, low: float = 0.0) -> DataFrame:
    """Dqf 0 beyond a limit; a limit of 0 is none."""
    bad = F.lit(False)
    if high:
        bad |= F.col("value") > high
    if low:
        bad |= F.col("value") < low
    return rows.withColumn("dqf", F.when(bad, 0).otherwise(1))
