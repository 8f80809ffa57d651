"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions alone.

Sizes are summed by source and hash bucket. In each source the buckets below its budget are taken whole; only
the bucket in which the budget ends is split further by the next hash bits. The result is one threshold a
source, so that taking a document is a comparison and nothing is sorted. Rows that repeat in doc_id and text share a hash;
where the budget ends among such rows, as many of them are taken as come nearest to it.

Defined results: null or empty text has size 0 and takes part; a null source is a source of its own, ordered
last; which of rows alike in doc_id and text are taken is open, how many is not; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import shared_folder, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more than this many times.
MOST = 3
BITS, LEVELS = 12, 4
#: Sources up to which the table of thresholds (about 60 bytes a source) is broadcast; beyond it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """48 bits that depend on the document alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(20), doc_id.cast("string"), F.crc32(F.coalesce(text, F.lit("")).cast("binary"))), 64 - BITS * LEVELS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, whole (copies of every document) and rest (words beyond those).

    All sizes are shared by weight; a source at ``most`` times its size stays there and the excess goes to the
    others. With sources in the order of their cap over their weight, the share per weight is the first one
    that does not exceed the next source's cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    ordered = W.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, onward = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    shared = (
        by_source.withColumn("weight", weight)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("share", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
        .withColumn("target", F.least(cap, F.col("share") * F.col("weight")))
    )
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("long")
    return shared.select("source", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("rest"))


def attach(docs: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    """Joins per-source columns to documents, null sources included."""
    side = by_source.withColumnRenamed("source", "_source")
    return docs.join(F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def thresholds(sized: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """One row a source: its targets, the hash below which its documents are taken once more, and the words left for rows of that hash. sized: source, size, hash."""
    plan = stored(targets(sized, weights, most), folder, "targets").withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("rest")})
    n_sources = plan.count()
    for level in range(LEVELS):
        low = BITS * (LEVELS - 1 - level)
        inside = attach(sized, plan.select("source", "prefix"), n_sources)
        if level:
            inside = inside.where(F.shiftrightunsigned("hash", low + BITS) == F.col("prefix"))
        histogram = inside.groupBy("source", F.shiftrightunsigned("hash", low).alias("bucket")).agg(F.sum("size").alias("words"))
        running = W.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("before", F.sum("words").over(running) - F.col("words"))
        ends = (
            attach(summed, plan.select("source", "left"), n_sources)
            .where(F.col("before") <= F.col("left"))
            .groupBy("source")
            .agg(F.max_by(F.struct("bucket", "before", "words"), "bucket").alias("end"))
            .select(F.col("source").alias("_source"), "end")
        )
        plan = stored(
            plan.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                *[c for c in ("source", "source_size", "target", "whole", "rest")],
                F.coalesce(F.col("end.bucket"), F.shiftleft("prefix", BITS)).alias("prefix"),
                F.greatest(F.lit(0.0), F.col("left") - F.coalesce(F.col("end.before"), F.lit(0))).alias("left"),
            ),
            folder,
            f"level{level}",
        )
    return plan.select("source", "source_size", "target", "whole", F.col("prefix").alias("threshold"), "left"), n_sources


def taken_times(rows: DataFrame, plan: DataFrame, n_sources: int, folder: str) -> DataFrame:
    """Adds ``times`` and the plan's columns to rows of source, size and hash.

    Rows of the hash in which a source's budget ends are written and numbered by the task that wrote them, so that none
    has to hold all of them.
    """
    known = attach(rows, plan, n_sources)
    tied = F.col("hash") == F.col("threshold")
    plain = known.where(~tied).withColumn("times", (F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)).cast("int"))
    ends = stored(known.where(tied).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), folder, "tied")
    of_part = ends.groupBy(F.col("source").alias("_source"), F.col("part").alias("_part")).agg(F.count("*").alias("n"))
    of_part = of_part.withColumn("before", F.sum("n").over(W.partitionBy("_source").orderBy("_part")) - F.col("n")).drop("n")
    number = F.row_number().over(W.partitionBy("source", "part").orderBy("place")) + F.col("before")
    counted = ends.join(of_part, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))).withColumn("number", number)
    nearest = F.when(F.col("size") > 0, F.floor(F.col("left") / F.col("size") + 0.5)).otherwise(0)
    counted = counted.withColumn("times", (F.col("whole") + F.when(F.col("number") <= nearest, 1).otherwise(0)).cast("int"))
    return plain.unionByName(counted.select(*plain.columns))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken: how much of each document a mix at the target weights takes."""
    folder = shared_folder(docs.sparkSession)
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash")), folder, "sized")
    plan, n_sources = thresholds(sized, folder, weights, most)
    return taken_times(sized, plan, n_sources, folder).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix themselves: each row as many times as it is taken, which may be none."""
    folder = shared_folder(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("hash"))
    plan, n_sources = thresholds(stored(rows.select("source", "size", "hash"), folder, "sized"), folder, weights, most)
    times = taken_times(rows, plan, n_sources, folder)
    return times.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("doc.*")
