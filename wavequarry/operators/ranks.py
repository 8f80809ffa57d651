"""Ranks and running sums over a whole table, by ranges of the ordering value; no window sees more than one range.

Rows are first summed by value, so that ties are one row and a value that a third of all rows share weighs no more than any other. Values are
dealt by ranges, each range is summed by itself, and the totals of the ranges before it (one row a partition) are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.sources import shared

#: Values with more than one in so many of the rows, and this many at least, get their rank by a broadcast.
HOT_SHARE, HOT_ROWS = 500, 200


def sums_before(values: DataFrame, order: str, sums: list[str], keys: list[str] | None = None) -> DataFrame:
    """Adds ``<sum>_before`` for each of the sums: their total over smaller values of ``order`` (of the same keys), 0 for the least.

    values: one row a value; nulls come last. Numbers stay exact as long as their totals fit.
    """
    keys = keys or []
    folder = shared.folder(values.sparkSession)
    ranged = values.repartitionByRange(*keys, F.col(order).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = shared.stored(ranged, folder, "ranged")
    totals = dealt.groupBy(*keys, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    offsets = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_offset") for s in sums])
    within = W.partitionBy(*keys, "_part").orderBy(F.col(order).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    x = dealt.withColumns({f"_{s}_within": F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums})
    met = F.col("_part") == F.col("_at")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    x = x.join(F.broadcast(offsets), met)
    return x.select(*values.columns, *[(F.col(f"_{s}_within") + F.col(f"_{s}_offset")).alias(f"{s}_before") for s in sums])


def mid_ranks(rows: DataFrame, value: str, rank: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the average rank of each row's value among all rows (of the same keys), from 1 up; a null value has none, NaN ranks above all numbers."""
    keys = keys or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    folder = shared.folder(rows.sparkSession)
    ranked = shared.stored(sums_before(counts, value, ["_n"], keys).select(*keys, value, "_n", (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(rank)), folder, "ranked")
    total = ranked.agg(F.sum("_n")).first()[0] or 0
    hot = F.col("_n") >= max(HOT_ROWS, -(-total // HOT_SHARE))  # of 500 values at most
    side = ranked.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(value).alias("_value"), "_n", rank)

    def met(null_safe: bool = True) -> Column:
        same = F.col(value).eqNullSafe(F.col("_value")) if null_safe else F.col(value) == F.col("_value")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        return same

    names = [*rows.columns, rank]
    warm = rows.join(F.broadcast(side.where(hot)), met(), "inner").select(*names)
    rest = rows.join(F.broadcast(side.where(hot)), met(), "left_anti")
    return warm.unionByName(rest.join(side.where(~hot), met(), "left").select(*names))
