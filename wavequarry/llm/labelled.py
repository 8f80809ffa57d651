"""Folds by document number and the bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds``; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """doc_id and label of at most ``most`` usable labelled documents, those of the smallest hashes; small enough to broadcast."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    return rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
