"""From raw documents to token ids: toxicity, quality, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and is run on all that the stage before it kept; ``run`` writes what a stage
returns as Parquet in the shared folder and reads it back as the next one's input.

Defined results: an empty table gives an empty one; null texts count as empty; rows are judged one by one, so rows that
share a doc_id may fare differently; null doc_ids take part; all but the last stage return the columns they were given,
whatever these are called. drop_toxic and drop_poor keep or drop equal texts alike. drop_near_duplicates keeps of each
component the row of the smallest doc_id (of several texts with that doc_id one, always the same), of rows alike in doc_id
and text one, and every row without words. mix takes a row as many times as the mix does, which may be none. encode
returns doc_id and what op2_bpe returns of it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry.llm import quality, toxicity
from wavequarry.llm.bpe import encode_digests
from wavequarry.llm.graph import join_hot
from wavequarry.llm.jaccard import linked_rows
from wavequarry.llm.mixing import mixed_documents
from wavequarry.llm.scratch import shared_folder, stored

ORACLE_SQL: str | None = None

#: Near duplicates share this percentage of their shingles of so many words; op3_jaccard has a contract of its own.
SHINGLE, PERCENT = 5, 80
#: Rows that near_duplicates drops, up to which their names are broadcast.
BROADCAST_ROWS = 1_000_000


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _spare_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _spare_name(docs, "toxicity")
    return toxicity.score(docs, toxicity.train(docs, _labels(spark, sf_dir)), score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = _spare_name(docs, "quality")
    return quality.score(docs, quality.train(docs, _labels(spark, sf_dir)), score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates, and all rows without words."""
    folder = shared_folder(spark)
    rows = linked_rows(docs, size=SHINGLE, percent=PERCENT).where("root is not null").select("root", "doc_id", "text_hash")
    rows = stored(rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows")), folder, "linked")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count("*").alias("members"))
    several = stored(first.where("members > 1"), folder, "several")
    goes = stored(join_hot(rows, several, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), folder, "goes")
    repeated = stored(rows.where("rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), folder, "repeated")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc.text") == F.col("_hash"))
    # few rows that go (16 bytes each) are sent to all tasks, so that no text has to move; more are joined by a shuffle
    goes = F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes
    left = whole.join(goes, same, "left_anti")
    if not repeated.isEmpty():
        again = whole.join(goes, same, "left_anti").join(repeated, same, "left_semi")
        one = again.groupBy(F.col("doc.doc_id").alias("_id"), F.xxhash64("doc.text").alias("_hash")).agg(F.first("doc").alias("doc")).select("doc")
        left = left.join(repeated, same, "left_anti").unionByName(one)
    return left.select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
