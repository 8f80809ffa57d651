"""Evaluation queries; embeddings stand for recordings (label: record, vec_id: channel), labelled documents for predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequarry.functions import arrays
from wavequarry.operators import baseline, evaluation
from wavequarry.plans.lookups import r6, table


def _frames(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "embeddings").select(F.col("label").alias("record"), F.col("vec_id").alias("channel"), F.posexplode("embedding").alias("step", "value"))
    v = F.col("value").cast("double")
    return evaluation.evidence(e.select("record", "channel", "step", v.alias("a"), F.abs(v).alias("b")), ["a", "b"])


def anomaly_summaries(spark, d):  # noqa: ANN001, ANN201
    x = evaluation.anomaly_summaries(_frames(spark, d))
    return x.select("record", *[r6(c).alias(c) for c in x.columns[1:]])


def anomaly_channels(spark, d):  # noqa: ANN001, ANN201
    return evaluation.anomaly_channels(_frames(spark, d)).withColumn("score", r6("score"))


def fold_counts(spark, d):  # noqa: ANN001, ANN201
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.fold_counts(x.select("lang", "quality"), "lang", "quality")


def out_of_fold_rise(spark, d):  # noqa: ANN001, ANN201
    """Whether a signal's last quarter is louder than its first, from measures of its first three quarters, by models that each leave one record's channels out."""
    e = table(spark, d, "embeddings").where("embedding is not null").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    n = F.size("x")
    quarter = (n / 4).cast("int")
    early, last = F.slice("x", F.lit(1), (n * 3 / 4).cast("int")), F.slice("x", n - quarter + 1, quarter)
    louder = arrays.rms(last) > arrays.rms(F.slice("x", F.lit(1), quarter))
    rows = e.select(F.col("vec_id").alias("record"), F.col("label").alias("group"), louder.cast("int").alias("label"), early.alias("x"))
    x = F.col("x")
    measures = {"mean": arrays.mean(x), "rms": arrays.rms(x), "line": arrays.line_length(x), "least": F.array_min(x), "most": F.array_max(x), "last": F.element_at(x, -1)}
    found = baseline.out_of_fold(rows.select("record", "group", "label", *[c.alias(k) for k, c in measures.items()]), list(measures))
    return found.select(F.col("record").alias("channel"), F.col("group").alias("record"), "fold", "label", r6("probability").alias("probability"))


def competition_metrics(spark, d):  # noqa: ANN001, ANN201
    """Quality predicted by length, onsets made from doc_id and length, and two lists of letters."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    k, n = F.col("doc_id"), F.col("n_chars")
    letters = ["a", "b", "c", "d"]
    rows = x.select(
        F.col("quality").alias("label"), F.least(n / 1600.0, F.lit(1.0)).alias("probability"), (k % 50).cast("double").alias("onset"), (n % 60).cast("double").alias("predicted_onset"),
        F.array(*map(F.lit, letters)).alias("channels"), F.when(k % 2 == 0, F.array(*map(F.lit, letters[::-1]))).otherwise(F.array(F.lit("x"), F.lit("a"))).alias("predicted_channels"),
    )
    m = evaluation.competition_metrics(rows, 0.5)
    return m.select(*[r6(c).alias(c) for c in m.columns])


QUERIES = {f.__name__: f for f in (anomaly_summaries, anomaly_channels, fold_counts, out_of_fold_rise, competition_metrics)}

_FRAMES = """e AS (SELECT label AS record, vec_id AS channel, i - 1 AS step, CAST(embedding[i] AS DOUBLE) AS a, abs(CAST(embedding[i] AS DOUBLE)) AS b FROM embeddings, range(1, len(embedding) + 1) r(i)),
    c AS (SELECT record, channel, step, a - median(a) FILTER (step < 10) OVER w AS a, b - median(b) FILTER (step < 10) OVER w AS b FROM e WINDOW w AS (PARTITION BY record, channel)),
    z AS (SELECT record, channel, step, greatest(0, (a / greatest(1.4826::DOUBLE * median(abs(a)) FILTER (step < 10) OVER w, 0.15::DOUBLE) + b / greatest(1.4826::DOUBLE * median(abs(b)) FILTER (step < 10) OVER w, 0.15::DOUBLE)) / 2) AS v FROM c WINDOW w AS (PARTITION BY record, channel))"""

ORACLES = {
    "anomaly_summaries": f"""WITH {_FRAMES}, q AS (SELECT record, step, quantile_cont(v, 0.9) AS l FROM z GROUP BY 1, 2),
        s AS (SELECT record, step, (coalesce(lag(l) OVER w, 0) + l + coalesce(lead(l) OVER w, 0)) / 3 AS l FROM q WINDOW w AS (PARTITION BY record ORDER BY step))
        SELECT record, round(max(l), 6) AS anomaly_max, round(median(l) FILTER (step >= 10), 6) AS anomaly_median, round(quantile_cont(l, 0.9) FILTER (step >= 10), 6) AS anomaly_q90, round(avg(l) FILTER (step >= 10), 6) AS anomaly_auc FROM s GROUP BY record""",
    "anomaly_channels": f"WITH {_FRAMES} SELECT record, channel, round(quantile_cont(v, 0.9), 6) AS score FROM z WHERE step >= 10 GROUP BY 1, 2",
    "fold_counts": """WITH x AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id))
        SELECT lang, count(*) AS held, CAST(sum(quality) AS BIGINT) AS held_positive, (SELECT count(*) FROM x) - count(*) AS learned, CAST((SELECT sum(quality) FROM x) - sum(quality) AS BIGINT) AS learned_positive FROM x GROUP BY lang""",
    "competition_metrics": """WITH x AS (SELECT quality AS y, least(n_chars / 1600.0::DOUBLE, 1.0::DOUBLE) AS s, abs(n_chars % 60 - doc_id % 50) AS err, doc_id % 2 AS odd FROM labels JOIN documents USING (doc_id)),
        g AS (SELECT 1 / (log2(2) * log2(3)) AS odd_gain, 1 / log2(2) ^ 2 + 1 / log2(3) ^ 2 + 1 / log2(4) ^ 2 + 1 / log2(5) ^ 2 AS best, 2 / (log2(2) * log2(5)) + 2 / (log2(3) * log2(4)) AS even_gain),
        r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2::DOUBLE AS k FROM x, g),
        t AS (SELECT sum(k) FILTER (y = 1) AS r, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (y = 1 AND s >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND s >= 0.5) AS DOUBLE) AS fp,
        sum(CASE WHEN s >= 0.5 THEN err ELSE 60 END) FILTER (y = 1) AS err, sum(CASE WHEN odd = 0 THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END) FILTER (y = 1 AND s >= 0.5) AS o, sum(CASE WHEN odd = 0 THEN even_gain ELSE odd_gain END / best) FILTER (y = 1 AND s >= 0.5) AS q FROM r),
        m AS (SELECT (r - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc, 2 * tp / (tp + fp + n1) AS f1, tp / n1 AS sensitivity, 1 - fp / n0 AS specificity, o / n1 AS channel_overlap, q / n1 AS channel_rank_proxy, err / n1 AS onset_mae FROM t),
        f AS (SELECT *, greatest(0, 1 - onset_mae / 60) AS onset_score FROM m), b AS (SELECT *, 0.25::DOUBLE * auc + 0.15::DOUBLE * f1 + 0.1::DOUBLE * sensitivity + 0.1::DOUBLE * specificity + 0.15::DOUBLE * onset_score AS base FROM f)
        SELECT round(auc, 6) AS auc, round(f1, 6) AS f1, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(channel_overlap, 6) AS channel_overlap, round(channel_rank_proxy, 6) AS channel_rank_proxy,
        round(onset_mae, 6) AS onset_mae, round(onset_score, 6) AS onset_score, round(base + 0.25::DOUBLE * channel_overlap, 6) AS score_overlap_proxy, round(base + 0.25::DOUBLE * channel_rank_proxy, 6) AS score_rank_proxy FROM b""",
}
