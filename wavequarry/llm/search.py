"""Ranked lexical search: term-bucketed postings joined with the terms of items, integer scores, sums by item and document.

``postings`` counts the terms of each whole text in the task that holds it. Its rows carry a bucket of their term's hash, by
which each file is sorted, so that a search reads the buckets it asks for; they stay with their document instead of going to
one task a term, since then sums of an item and a document can be formed where the document is: only postings are shuffled, by
document, never the far more numerous matches (9.5 times as many over 0.1 GB), and no term is too common for a task.

Defined results: null and empty texts have no terms and count neither for N nor for L; rows that share a doc_id are documents of
their own and may both be ranked, in an order left open where their scores are equal; a null doc_id is ranked last among equals;
items without terms have no rows; rows of items that share an item_id are one item; empty tables give no rows; other columns
are ignored. Terms are counted in pieces of a megabyte; what is held of a long text are its distinct terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import shared_folder, small_batches, stored

#: Buckets of terms.
BUCKETS = 256
#: Distinct terms of all items up to which these are sent to the tasks that count (some 60 MB); beyond it every term is stored.
SENT_TERMS = 500_000
#: Rows of item terms that are broadcast to be joined (about 40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_TERMS = 500_000
PIECE = 1 << 20
#: Lower-cases A-Z and turns every byte that no term holds into a space. Bytes from 128 on belong to terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = "row long, doc_id long, n long, bucket int, term string, tf long"


def term_counts(data: bytes) -> Counter:
    """Occurrences of each term of a text's UTF-8 bytes."""
    plain = data.translate(TERMS)
    found: Counter = Counter()
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def postings(docs: DataFrame, wanted: set[bytes] | None = None) -> DataFrame:
    """POSTINGS of rows (row, doc_id, text): one row a term and document, and one without a term for every document that has any.

    ``wanted`` leaves out other terms; n counts all terms of the text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows, ids, lengths, terms, times = [], [], [], [], []
                for row, doc, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                    counts = term_counts((text.as_py() or "").encode())
                    if not counts:
                        continue
                    own = counts.keys() if wanted is None else counts.keys() & wanted
                    n, k = sum(counts.values()), len(own) + 1
                    rows += [row] * k
                    ids += [doc] * k
                    lengths += [n] * k
                    terms += [None, *own]
                    times += [0, *(counts[t] for t in own)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["row", "doc_id", "n", "term", "tf"])

    counted = small_batches(docs.select("row", F.col("doc_id").cast("long"), "text")).mapInArrow(work, "row long, doc_id long, n long, term string, tf long")
    return counted.withColumn("bucket", bucket_of("term")).select(*[c.split()[0] for c in POSTINGS.split(", ")])


def bucket_of(term: str) -> Column:
    """-1 for the row that stands for the document itself."""
    return F.when(F.col(term).isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def index(docs: DataFrame, folder: str, wanted: set[bytes] | None = None) -> DataFrame:
    """Stored postings of all rows, each file sorted by bucket and term; ``row`` numbers the rows of docs."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stored(postings(numbered, wanted).sortWithinPartitions("bucket", "term"), folder, "postings")


def item_terms(items: DataFrame, folder: str) -> DataFrame:
    """item_id, bucket, term and how often the item has it."""
    rows = postings(items.select(F.lit(0).cast("long").alias("row"), F.col("item_id").alias("doc_id"), "text"))
    return stored(rows.where("bucket >= 0").groupBy(F.col("doc_id").alias("item_id"), "bucket", "term").agg(F.sum("tf").alias("times")), folder, "items")


def weighted(asked: DataFrame, found: DataFrame, documents: int) -> DataFrame:
    """asked with the weight of each term, from its number of documents."""
    frequency = found.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(frequency, ["bucket", "term"]).select("item_id", "bucket", "term", (weight * F.col("times")).alias("weight"))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    folder = shared_folder(docs.sparkSession)
    asked = item_terms(items, folder)
    distinct = asked.select("term").distinct()
    n_terms = distinct.count()
    wanted = {r[0].encode() for r in distinct.collect()} if n_terms <= SENT_TERMS else None
    every = index(docs, folder, wanted)
    documents, length = every.where("bucket = -1").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = every.where("bucket >= 0")
    weights = stored(weighted(asked, found, documents), folder, "weights")
    side = F.broadcast(weights) if weights.count() <= BROADCAST_TERMS else weights
    m = F.lit(25) + F.expr(f"(75 * n * {documents}L) div {max(length, 1)}L")
    share = found.withColumn("m", m.cast("long")).withColumn("share", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")).select("row", "doc_id", "bucket", "term", "share")
    matches = share.repartition("row").join(side, ["bucket", "term"])
    scores = matches.groupBy("row", "item_id", "doc_id").agg(F.sum(F.col("weight") * F.col("share")).alias("score")).where("score > 0")
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
