"""Sharding by a Feistel permutation with cycle walking over global row numbers.

The permutation of 0 to N-1 is computed from the row number alone, so shard and slot of any row follow without
a sort of the data: with p the permuted number, shard = p mod shards and slot = p div shards. Shard counts
therefore differ by one at most (law ``rows``).

Row numbers come from 4,096 fixed hash buckets and depend on doc_id, size and text checksum only, not on files or
partitions. Rows alike in all three are numbered next to each other; equal texts are spread like any others.
Null text counts as empty; null doc_ids take part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textkernel import mix

SHARDS = 40
BUCKETS = 4096
ROUNDS = 6
#: Rows alike beyond this many are expanded in pieces over several tasks.
PIECE = 10_000


def permute(rows: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed Feistel network with cycle walking puts each of the numbers 0 to n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = once(rows.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def numbered(keys: DataFrame) -> DataFrame:
    """Adds ``row``, a global number from 0, to rows of doc_id, size, text_crc32."""
    cols = ["doc_id", "size", "text_crc32"]
    alike = keys.groupBy(*cols).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)))
    before = (
        alike.groupBy("bucket").agg(F.sum("n").alias("rows"))
        .select("bucket", (F.sum("rows").over(W.orderBy("bucket")) - F.col("rows")).alias("offset"))
    )  # BUCKETS rows at most
    inside = F.sum("n").over(W.partitionBy("bucket").orderBy(*[F.col(c).asc_nulls_first() for c in cols]).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = alike.withColumn("inside", inside).join(F.broadcast(before), "bucket").withColumn("first", F.col("offset") + F.col("inside"))
    few = placed.where(F.col("n") <= PIECE).withColumns({"from": F.lit(0).cast("long"), "to": F.col("n") - 1})
    many = (
        placed.where(F.col("n") > PIECE)
        .withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))))
        .withColumn("to", F.least(F.col("from") + PIECE - 1, F.col("n") - 1))
        .repartition(F.col("first"), F.col("from"))
    )
    return few.unionByName(many).select(*cols, F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.col("to"))).alias("row"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, key: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    n = keys.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column("row").to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(["rows"] * len(p), pa.string()), pa.array((p % shards).astype(np.int32)), pa.array(p // shards), pa.nulls(len(p), pa.int32())],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return numbered(keys).mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
