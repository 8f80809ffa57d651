"""Kernels over one window of samples, kept in the JVM as higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the least positive normal single, below which logarithms are cut.
TINY = 1.1754943508222875e-38


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def centred(x: Column) -> Column:
    return F.transform(x, lambda v: v - mean(x))


def differences(x: Column) -> Column:
    return F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda a, b: a - b)


def line_length(x: Column) -> Column:
    return mean(F.transform(differences(x), F.abs))


def rms(x: Column) -> Column:
    return F.sqrt(mean(F.transform(x, lambda v: v * v)))


def teager(x: Column) -> Column:
    """Mean of |x[i]^2 - x[i-1] x[i+1]|."""
    inner = F.transform(F.sequence(F.lit(2), F.size(x) - 1), lambda i: F.abs(F.element_at(x, i) * F.element_at(x, i) - F.element_at(x, i - 1) * F.element_at(x, i + 1)))
    return mean(inner)


def kurtosis(x: Column) -> Column:
    """Fourth over squared second moment of a centred window (3 for a normal one)."""
    second = mean(F.transform(x, lambda v: v * v))
    return mean(F.transform(x, lambda v: v * v * v * v)) / F.greatest(second * second, F.lit(TINY))


def log_floor(v: Column) -> Column:
    return F.log(F.greatest(v, F.lit(TINY)))


def tapered_power(x: Column, n: int, bins: range) -> dict[int, Column]:
    """|DFT|^2 of the symmetric Hann-tapered window at some bins; for short windows, long ones go through a NumPy kernel."""
    out = {}
    for k in bins:
        re = F.array(*[F.lit((0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) * math.cos(2 * math.pi * k * i / n)) for i in range(n)])
        im = F.array(*[F.lit((0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) * math.sin(2 * math.pi * k * i / n)) for i in range(n)])
        a, b = total(F.zip_with(x, re, lambda p, q: p * q)), total(F.zip_with(x, im, lambda p, q: p * q))
        out[k] = a * a + b * b
    return out
