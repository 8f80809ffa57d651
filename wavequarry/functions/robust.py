"""Robust statistics and ordered smoothing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: The factor from a median absolute deviation to a standard deviation, and the least scale.
MAD_FACTOR, LEAST_SCALE = 1.4826, 1e-6


def baseline_stats(value: Column, inside: Column) -> dict[str, Column]:
    """First pass of a robust z-score: median and population deviation of the rows inside the baseline."""
    return {"center": F.median(F.when(inside, value)), "spread": F.stddev_pop(F.when(inside, value))}


def robust_scale(mad: Column, spread: Column) -> Column:
    scaled = F.lit(MAD_FACTOR) * mad
    return F.greatest(F.when(scaled > LEAST_SCALE, scaled).otherwise(spread), F.lit(LEAST_SCALE))


def causal_mean(value: Column, ordered: WindowSpec, points: int) -> Column:
    """Mean of the last ``points`` rows, fewer at the start."""
    return F.avg(value).over(ordered.rowsBetween(1 - points, 0))


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def median_filter3(value: Column, ordered: WindowSpec) -> Column:
    """Centred median of three; an edge repeats itself and so stays as it is."""
    return median_of_three(F.coalesce(F.lag(value).over(ordered), value), value, F.coalesce(F.lead(value).over(ordered), value))


def mean3_padded(value: Column, ordered: WindowSpec) -> Column:
    zero = F.lit(0.0)
    return (F.coalesce(F.lag(value).over(ordered), zero) + value + F.coalesce(F.lead(value).over(ordered), zero)) / 3


def mid_rank(value: Column, ordered: WindowSpec, alike: WindowSpec) -> Column:
    """Average rank of ties; null stays null. ``ordered`` sorts nulls last."""
    return F.when(value.isNotNull(), F.rank().over(ordered) + (F.count(value).over(alike) - 1) / 2)


def mean_present(*columns: Column) -> Column:
    """Mean of the values that are there."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return total / F.nullif(sum((c.isNotNull().cast("int") for c in columns), F.lit(0)), F.lit(0))
