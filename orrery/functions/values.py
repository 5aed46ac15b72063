"""Value functions of channels (B07) and bases of fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Fixed values of the value functions.
PAD_VALUE, NORM_BAR = 10.25, 0.01

VALUES = {
    "pad": lambda v: F.when(v == PAD_VALUE, 1.0).otherwise(0.0),
    "norm": lambda v: F.when(v > NORM_BAR, 1.0).otherwise(0.0),
    "bin": lambda v: F.when(v == 1, 1.0).otherwise(0.0),
}


def fourier(x: Column, order: int, period: float, unit: float = 3600.0, constant: bool = True) -> Column:
    """F14 (x in hours), F19 (unit 86400, x in days): [1,] sin wx, cos wx, sin 2wx, ..."""
    w = 2 * math.pi * unit / period
    terms = [f(x * (w * k)) for k in range(1, order + 1) for f in (F.sin, F.cos)]
    return F.array(*([F.lit(1.0)] if constant else []), *terms)


def extended_fourier(x: Column, plain: int, scaled: int, period: float, unit: float = 3600.0) -> Column:
    """1, sines and cosines, x, and x times sines and cosines."""
    w = 2 * math.pi * unit / period
    first = [f(x * (w * k)) for k in range(1, plain + 1) for f in (F.sin, F.cos)]
    second = [x * f(x * (w * k)) for k in range(1, scaled + 1) for f in (F.sin, F.cos)]
    return F.array(F.lit(1.0), *first, x, *second)


def dot(features: Column, params: Column) -> Column:
    """scalar product of two arrays."""
    return F.aggregate(F.zip_with(features, params, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def powers(x: Column, degree: int, first: int = 0) -> Column:
    """x**first, ..., x**(first + degree - 1)."""
    return F.array(*(F.lit(1.0) if p == 0 else F.pow(x, F.lit(float(p))) for p in range(first, first + degree)))
