"""The prediction contract over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequarry.operators.predictions import violations
from wavequarry.plans.lookups import table


def prediction_contract_violations(spark, d):  # noqa: ANN001, ANN201
    """Each label as a prediction: quality as probability, n_chars as onset, and no channels."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").cast("double").alias("prob"), F.lit(0.5).alias("decision_threshold"),
        (F.col("n_chars") / 100.0).alias("onset_time"), F.array().cast("array<string>").alias("channels"),
    )
    documents = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    return violations(rows, documents.select("sample_id", F.col("sample_id").alias("channel_id")), documents)


QUERIES = {"prediction_contract_violations": prediction_contract_violations}

ORACLES = {
    "prediction_contract_violations": """WITH p AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, quality, n_chars / 100.0 AS onset FROM labels JOIN documents USING (doc_id))
        SELECT sample_id, 'onset' AS violation FROM p WHERE onset < 0 OR onset >= 60
        UNION ALL SELECT sample_id, 'channel count' FROM p WHERE quality >= 0.5
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'missing id' FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT sample_id FROM p)""",
}
