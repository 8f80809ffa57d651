"""Joins with hot keys, and connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored

#: Keys that are joined by a broadcast, at most, and rows from which on a key may be one of them.
HOT_KEYS, HOT_ROWS = 512, 200


def join_hot(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, which has one row a key.

    The keys with most rows (HOT_KEYS at most) get their facts by a broadcast of as many rows, so that no task has to
    read all rows of a hot key; any other key has less than one in HOT_KEYS of the rows.
    """
    hot = [r[0] for r in rows.groupBy(key).count().where((F.col("count") >= HOT_ROWS) & F.col(key).isNotNull()).orderBy(F.desc("count"), key).limit(HOT_KEYS).collect()]
    if not hot:
        return rows.join(facts, key, how)
    warm = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(~warm).join(facts.where(~warm), key, how).unionByName(rows.where(warm).join(F.broadcast(facts.where(warm)), key, how))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root for every node that has an edge (a, b); the root is the smallest node reachable.

    Each round reads and writes whole tables in the shared folder; rounds grow with the logarithm of the longest path.
    """

    def state(e: DataFrame) -> tuple[int, int]:
        row = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        return row[0], row[1]

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, "edges0")
    before, turn = state(current), 0
    while before[0]:
        turn += 1
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(join_hot(both, lowest, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), folder, f"large{turn}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_hot(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), folder, f"edges{turn}")
        discard(current.sparkSession, folder, f"large{turn}", f"edges{turn - 1}")
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
