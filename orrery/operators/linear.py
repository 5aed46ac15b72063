"""Linear fits on one Gram aggregation: constant, polynomial, Fourier, multilinear, ridge, robust."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import dot


def gram_fit(rows: DataFrame, keys: list[str], features: Column, *, y: str = "value", weight: Column | None = None, ridge: float = 0.0, intercept: bool = False) -> DataFrame:
    """Least squares of y on the features of each key: params ARRAY<DOUBLE>, n.

    Tasks add up x x', x y for their rows; one small matrix a key and task is shuffled, so wide bases and hot
    keys cost no more. Ridge standardises the features and leaves the intercept alone. Singular systems get
    the least-norm solution.
    """
    data = rows.select(*keys, features.alias("_x"), F.col(y).cast("double").alias("_y"), (F.lit(1.0) if weight is None else weight).alias("_w"))
    kinds = ", ".join(f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                x = np.stack(part._x.to_numpy())
                a = np.column_stack([np.ones(len(x)), x, part._y.to_numpy()])
                g = (a * part._w.to_numpy()[:, None]).T @ a
                g = np.append(g.ravel(), len(part))
                sums[key] = sums[key] + g if key in sums else g
        if sums:
            yield pd.DataFrame([[*k, v.tolist()] for k, v in sums.items()], columns=[*keys, "g"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf.g.to_numpy()), 0)
        n, g = int(total[-1]), total[:-1]
        m = int(np.sqrt(len(g)))
        g = g.reshape(m, m)
        if intercept:
            mean = g[0, 1:-1] / g[0, 0]
            my = g[0, -1] / g[0, 0]
            cov, cy = g[1:-1, 1:-1] - g[0, 0] * np.outer(mean, mean), g[1:-1, -1] - g[0, 0] * mean * my
            sd = np.sqrt(np.maximum(np.diag(cov), 0) / g[0, 0])
            live = sd > 1e-12 * np.maximum(1.0, np.abs(mean))
            coef = np.zeros(m - 2)
            if live.any():
                s = sd[live]
                coef[live] = np.linalg.lstsq(cov[np.ix_(live, live)] / np.outer(s, s) + ridge * np.eye(int(live.sum())), cy[live] / s, rcond=None)[0] / s
            params = [float(my - mean @ coef), *coef.tolist()]
        else:
            d = np.sqrt(np.maximum(np.diag(g)[1:-1], 1e-300))
            params = (np.linalg.lstsq(g[1:-1, 1:-1] / np.outer(d, d) + ridge * np.eye(m - 2), g[1:-1, -1] / d, rcond=None)[0] / d).tolist()
        return pd.DataFrame([[*pdf[keys].iloc[0], params, n]], columns=[*keys, "params", "n"])

    return data.mapInPandas(partial, f"{kinds}, g array<double>").groupBy(*keys).applyInPandas(solve, f"{kinds}, params array<double>, n long")


def constant_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """the mean of valid rows."""
    kept = rows.where("dqf = 1") if "dqf" in rows.columns else rows
    return kept.groupBy(*keys).agg(F.avg("value").alias("mu"))


def line_fit(rows: DataFrame, keys: list[str], x: str, y: str = "value") -> DataFrame:
    """F08 of degree 1, F12 with one regressor: intercept and slope without a Python task."""
    return rows.groupBy(*keys).agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n"))


def robust_line(rows: DataFrame, keys: list[str], x: str, y: str = "value", rounds: int = 30) -> DataFrame:
    """minimises the sum of 2 (sqrt(1 + r^2) - 1) by reweighting; each round is one aggregation of five sums; one small row a key comes to the driver, and it stops when no row moves."""
    fit = line_fit(rows, keys, x, y).select(*keys, F.col("intercept").alias("p0"), F.col("slope").alias("p1"))
    last: pd.DataFrame | None = None
    for _ in range(rounds):
        r = F.col(y) - F.col("p0") - F.col("p1") * F.col(x)
        w = 1 / F.sqrt(1 + r * r)
        s = rows.join(fit, keys).withColumn("_w", w).groupBy(*keys).agg(*(F.sum(F.col("_w") * e).alias(a) for a, e in (("s", F.lit(1.0)), ("sx", F.col(x)), ("sy", F.col(y)), ("sxx", F.col(x) * F.col(x)), ("sxy", F.col(x) * F.col(y)))))
        det = F.expr("nullif(s * sxx - sx * sx, 0)")
        fit = s.select(*keys, ((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det).alias("p0"), ((F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).alias("p1"))
        got = fit.toPandas().sort_values(keys).reset_index(drop=True)
        fit = rows.sparkSession.createDataFrame(got, fit.schema)
        if last is not None and len(got) == len(last) and np.allclose(got[["p0", "p1"]], last, rtol=1e-9, atol=1e-12, equal_nan=True):
            break
        last = got[["p0", "p1"]]
    return fit


def ridge_two(rows: DataFrame, keys: list[str], a: str, b: str, y: str, alpha: float) -> DataFrame:
    """F16 for two features in closed form, standardised by population sigma, as one aggregation."""
    z = lambda c: f"({c} - _m{c}) / _s{c}"
    m = rows.groupBy(*keys).agg(*(f(c).alias(f"{p}{c}") for c in (a, b, y) for f, p in ((F.avg, "_m"), (F.stddev_pop, "_s"))))
    s = rows.join(m, keys).groupBy(*keys, *(f"{p}{c}" for c in (a, b, y) for p in ("_m", "_s"))).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"{z(a)} * {z(b)}")).alias("ab"), F.sum(F.expr(f"{z(a)} * ({y} - _m{y})")).alias("ay"), F.sum(F.expr(f"{z(b)} * ({y} - _m{y})")).alias("by"))
    d = (F.col("n") + alpha) * (F.col("n") + alpha) - F.col("ab") * F.col("ab")
    ca = (F.col("ay") * (F.col("n") + alpha) - F.col("by") * F.col("ab")) / d / F.col(f"_s{a}")
    cb = (F.col("by") * (F.col("n") + alpha) - F.col("ay") * F.col("ab")) / d / F.col(f"_s{b}")
    return s.withColumns({"ca": ca, "cb": cb}).select(*keys, (F.col(f"_m{y}") - F.col("ca") * F.col(f"_m{a}") - F.col("cb") * F.col(f"_m{b}")).alias("intercept"), "ca", "cb")


def predict(rows: DataFrame, models: DataFrame, keys: list[str], features: Column, *, fallback: Column | None = None) -> DataFrame:
    """trend = features . params, or the fallback where there is no model."""
    out = rows.join(models.select(*keys, "params"), keys, "left")
    return out.withColumn("trend", F.when(F.col("params").isNull(), F.lit(0.0) if fallback is None else fallback).otherwise(dot(features, F.col("params")))).drop("params")


def bands(trend: Column, sigma: Column, warning: Column | float, error: Column | float) -> dict[str, Column]:
    """trend and its warning and error bands."""
    return {"trend": trend, "warning_low": trend - warning * sigma, "warning_high": trend + warning * sigma, "error_low": trend - error * sigma, "error_high": trend + error * sigma, "stddev": sigma}
