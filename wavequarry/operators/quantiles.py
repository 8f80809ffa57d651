"""Exact quantiles of groups of any size, by value histograms that are refined where the wanted ranks lie.

Spark's percentile keeps a map of all distinct values of a group in one task. Here groups of more than ``HOT`` rows are counted in
BINS ranges of equal width between their least and greatest value; of those only the range that holds a wanted rank is counted
again, between the least and greatest value found in it, until it holds a single value. Each round drops values, mostly all but one
in some thousands, and a count of any size is summed on the way, so two groups keep as many tasks busy as two thousand.

Quantiles are those of ``percentile``: linear between the two nearest ranks. Null and NaN are left out, a group without values has
no row; infinities count as the greatest finite numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.functions import robust
from wavequarry.sources import shared

HOT, BINS = 1_000_000, 4096
#: Groups beyond HOT up to which their ranges (40 bytes each) are broadcast to be met by the rows.
BROADCAST_RANGES = 200_000
GREATEST = 1.7976931348623157e308


def _at(rows: DataFrame, side: DataFrame, keys: list[str], extra: Column | None = None, how: str = "inner") -> DataFrame:
    """rows joined with a side whose keys are named _key_..., nulls alike."""
    met = F.lit(True) if extra is None else extra
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    small = side.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    return rows.join(F.broadcast(side) if small else side, met, how)


def _named(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *columns)


def _selected(rows: DataFrame, sizes: DataFrame, keys: list[str], probs: list[float], folder: str) -> DataFrame:
    """keys, q of the hot groups. rows: keys, _v; sizes: keys, _n, _lo, _hi."""
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(*[f(p * (F.col("_n") - 1)).cast("long") for f in (F.floor, F.ceil)]) for p in map(F.lit, probs)])))
    goal = shared.stored(sizes.select(*keys, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before")), folder, "goal0")
    turn = 0
    while True:
        turn += 1
        ranges = _named(goal.where("_lo < _hi").select(*keys, "_lo", "_hi").distinct(), keys, "_lo", "_hi")
        if ranges.isEmpty():
            break
        inside = _at(rows, ranges, keys, (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        # halves, so that the width of a range is finite
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bins = inside.select(*keys, "_lo", "_hi", "_v", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int").alias("_bin"))
        bins = bins.groupBy(*keys, "_lo", "_hi", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = F.sum("_c").over(W.partitionBy(*keys, "_lo", "_hi").orderBy("_bin"))  # BINS rows at most
        bins = bins.withColumn("_upto", upto)
        side = bins.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_c", "_least", "_most", "_upto")
        place = F.col("_rank") - F.col("_before")
        hit = (F.col("_lo") == F.col("_from")) & (F.col("_hi") == F.col("_to")) & (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c"))
        for k in keys:
            hit = hit & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        closer = goal.where("_lo < _hi").join(side, hit).select(*keys, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"))
        goal = shared.stored(goal.where("_lo = _hi").unionByName(closer), folder, f"goal{turn}")
    found = goal.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_values"))  # two entries a quantile
    x = _at(sizes, _named(found, keys, "_values"), keys)
    quantile = []
    for p in map(F.lit, probs):
        at = p * (F.col("_n") - 1)
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.col("_values")[low], F.col("_values")[high]
        quantile.append(F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b))
    return x.select(*keys, F.array(*quantile).alias("q"))


def quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], hot: int = HOT) -> DataFrame:
    """keys, q: an array of the wanted quantiles of each group, exact. Groups of more than ``hot`` values are selected by histograms."""
    folder = shared.folder(rows.sparkSession)
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(GREATEST)), F.lit(-GREATEST))
    x = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, v.alias("_v"))
    sizes = shared.stored(x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), folder, "sizes")
    large = sizes.where(F.col("_n") > hot)
    if large.isEmpty():
        own = x
    else:
        own = _at(x, _named(large, keys, "_n"), keys, how="left_anti")
    array = F.array(*map(F.lit, probs))
    plain = own.groupBy(*keys).agg(F.percentile("_v", array).alias("q"))
    if large.isEmpty():
        return plain
    chosen = shared.stored(_at(x, _named(large, keys, "_n"), keys).select(*keys, "_v"), folder, "chosen")
    return plain.unionByName(_selected(chosen, large, keys, probs, folder))


def robust_stats(rows: DataFrame, keys: list[str], value: str, hot: int = HOT) -> DataFrame:
    """keys, center, mad, spread, scale: median, median absolute deviation and population deviation of each group, and the scale made of them."""
    folder = shared.folder(rows.sparkSession)
    middle = shared.stored(quantiles(rows, keys, value, [0.5], hot).select(*keys, F.col("q")[0].alias("center")), folder, "middle")
    away = _at(rows.select(*keys, F.col(value).cast("double").alias("_x")), _named(middle, keys, "center"), keys).select(*keys, F.abs(F.col("_x") - F.col("center")).alias("_away"))
    mad = quantiles(away, keys, "_away", [0.5], hot).select(*keys, F.col("q")[0].alias("mad"))
    spread = rows.where(~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.stddev_pop(value).alias("spread"))
    x = _at(_at(middle, _named(mad, keys, "mad"), keys).select(*keys, "center", "mad"), _named(spread, keys, "spread"), keys).select(*keys, "center", "mad", "spread")
    return x.withColumn("scale", robust.robust_scale(F.col("mad"), F.col("spread")))
