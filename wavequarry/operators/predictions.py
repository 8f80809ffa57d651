"""The prediction contract: what is wrong with each row, smoke predictions, and the file that holds them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Onsets lie before this second; a positive row names so many channels.
BOUND, NAMED = 60.0, 10
COLUMNS = ["sample_id", "prob", "decision_threshold", "onset_time", *(f"ch{k}" for k in range(1, NAMED + 1))]


def _outside(name: str, high: float, closed: bool) -> F.Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) | (c < 0) | (c > high if closed else c >= high)


def violations(predictions: DataFrame, eligible: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(sample_id, violation) for each rule that a row breaks; no rows for a valid table that is not empty.

    predictions(sample_id, prob, decision_threshold, onset_time, channels), eligible(sample_id, channel_id), and
    expected(sample_id) where coverage counts. A row is positive from its threshold on. Null channels are no channels.
    """
    p = predictions.withColumn("channels", F.coalesce("channels", F.array().cast("array<string>")))
    allowed = eligible.groupBy("sample_id").agg(F.collect_set("channel_id").alias("allowed"))
    lowest = predictions.agg(F.min("decision_threshold").alias("lowest"))  # one row
    p = p.withColumn("times", F.count("*").over(W.partitionBy("sample_id"))).join(allowed, "sample_id", "left").join(F.broadcast(lowest))
    positive, n = F.col("prob") >= F.col("decision_threshold"), F.size("channels")
    unfit = F.size(F.array_except("channels", F.coalesce("allowed", F.array().cast("array<string>")))) > 0
    rules = {
        "duplicate id": F.col("times") > 1,
        "empty id": F.col("sample_id").isNull() | (F.trim("sample_id") == ""),
        "probability": _outside("prob", 1.0, True),
        "threshold": _outside("decision_threshold", 1.0, True),
        "onset": _outside("onset_time", BOUND, False),
        "channel count": positive & (n != NAMED) | ~positive & (n > 0),
        "repeated channel": n > F.size(F.array_distinct("channels")),
        "ineligible channel": positive & unfit,
        "several thresholds": F.col("decision_threshold") > F.col("lowest"),
    }
    named = F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items())))
    found = p.select("sample_id", F.explode(named).alias("violation")).distinct()
    if expected is None:
        return found
    lacking = expected.join(predictions, "sample_id", "left_anti").select("sample_id", F.lit("missing id").alias("violation"))
    surplus = predictions.join(expected, "sample_id", "left_anti").select("sample_id", F.lit("unexpected id").alias("violation")).distinct()
    return found.unionByName(lacking).unionByName(surplus)


def negative_predictions(ids: DataFrame) -> DataFrame:
    """A valid table that calls every record negative."""
    return ids.select("sample_id", F.lit(0.0).alias("prob"), F.lit(0.5).alias("decision_threshold"), F.lit(0.0).alias("onset_time"), F.array().cast("array<string>").alias("channels"))


def _checked(predictions: DataFrame, eligible: DataFrame, expected: DataFrame) -> None:
    if predictions.isEmpty():
        raise ValueError("no predictions")
    wrong = violations(predictions, eligible, expected).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['sample_id']}: {r['violation']}" for r in wrong))


def write_predictions(predictions: DataFrame, eligible: DataFrame, expected: DataFrame, path: str) -> int:
    """Writes one CSV file by sample_id, numbers with six decimals; raises and leaves no file unless what it reads back is valid too.

    The file is the deliverable and lies on the driver; rows stream to it, partition by partition.
    """
    _checked(predictions, eligible, expected)
    spark, rows, draft = predictions.sparkSession, 0, f"{path}.{uuid.uuid4().hex}"
    try:
        with open(draft, "w", encoding="utf-8", newline="") as out:
            out.write(",".join(COLUMNS) + "\n")
            for r in predictions.orderBy("sample_id").toLocalIterator():
                named = list(r["channels"] or [])
                numbers = (f"{r[c]:.6f}" for c in COLUMNS[1:4])
                out.write(",".join([r["sample_id"], *numbers, *named, *[""] * (NAMED - len(named))]) + "\n")
                rows += 1
            out.flush()
            os.fsync(out.fileno())
        text = spark.read.option("header", True).csv(f"file://{os.path.abspath(draft)}")
        if text.columns != COLUMNS or text.count() != rows:
            raise ValueError("the file does not read back as written")
        back = text.select("sample_id", *(F.col(c).cast("double").alias(c) for c in COLUMNS[1:4]), F.array_compact(F.array(*COLUMNS[4:])).alias("channels"))
        _checked(back, eligible, expected)
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)
    return rows
