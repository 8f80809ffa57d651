"""Kept runs of the linear baseline: held-out predictions, folds, metrics and the model of all records, published whole or not at all.

A run writes its parts under its own name, ``root/runs/<run>``, and last a manifest row, ``root/manifests/run=<run>``. Readers
see listed runs only, so a writer that dies leaves the run before it in force, and writing the same run again is harmless.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wavequarry.operators import baseline, evaluation
from wavequarry.sources import shared

MANIFEST = "run string, version long, decision_threshold double, onset_threshold double, features array<string>"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """A row for every published run; none where nothing has been published."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifests")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], MANIFEST)
        raise


def latest(spark: SparkSession, root: str) -> Row | None:
    """The run in force: of the highest version, and of two writers that chose the same one, the last by name."""
    return manifests(spark, root).orderBy(F.desc("version"), F.desc("run")).first()


def _publish(spark: SparkSession, root: str, run: str, decision: float, onset: float | None, features: list[str]) -> int:
    last = latest(spark, root)
    version = 1 + (last["version"] if last else 0)
    row = spark.createDataFrame([(run, version, decision, onset, features)], MANIFEST).drop("run")
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/run={run}")
    return version


def held_out(rows: DataFrame, track: DataFrame, ranked: DataFrame, thresholds: DataFrame, columns: list[str]) -> DataFrame:
    """sample_id, fold, schema_group, label, prob, predicted_label, true_onset, predicted_onset, pred_ch1 to pred_ch10 of rows (record, label, group, onset, features).

    The onset is the one at the fold's own threshold, null where no other group has a positive record; records without ten ranked channels have null names.
    """
    k = F.array_position(F.array(*map(F.lit, baseline.THRESHOLDS)), F.col("threshold")).cast("int")
    probability = baseline.out_of_fold(rows, columns).select("record", "fold", "probability")
    own = rows.select("record", "group", "label", "onset").join(probability, "record")
    own = own.join(thresholds, own["group"].eqNullSafe(thresholds["group"]), "left").drop(thresholds["group"])
    own = own.join(baseline.onsets(track, baseline.THRESHOLDS), "record", "left").join(ranked, "record", "left")
    return own.select(
        F.col("record").alias("sample_id"), "fold", F.col("group").alias("schema_group"), "label", F.col("probability").alias("prob"), (F.col("probability") >= baseline.DECISION).cast("int").alias("predicted_label"),
        F.col("onset").alias("true_onset"), F.when(k > 0, F.get("onsets", k - 1)).alias("predicted_onset"), *[F.get("channels", F.lit(i)).alias(f"pred_ch{i + 1}") for i in range(baseline.NAMED)],
    )


def save(features: DataFrame, labels: DataFrame, track: DataFrame, ranked: DataFrame, root: str, columns: list[str] = baseline.FEATURES, run: str | None = None) -> int:
    """Fits, evaluates and publishes a run; returns its version. A run that is listed already is left as it is.

    features (record, columns), labels (record, label, group, onset, channels: the true ones), track and ranked as :mod:`baseline` makes them.
    """
    spark, run = features.sparkSession, run or uuid.uuid4().hex
    known = manifests(spark, root).where(F.col("run") == run).first()
    if known:
        return known["version"]
    place = f"{root}/runs/{run}"
    rows = shared.stored(features.select("record", *columns).join(labels.select("record", "label", "group", "onset"), "record"), shared.folder(spark), "run_rows")
    thresholds = shared.stored(baseline.fold_thresholds(track, labels), shared.folder(spark), "run_thresholds")  # a row a group
    held_out(rows, track, ranked, thresholds, columns).write.mode("overwrite").parquet(f"{place}/predictions")
    kept = spark.read.parquet(f"{place}/predictions")
    folds = evaluation.fold_counts(kept.select("fold", "label"), "fold", "label").join(kept.groupBy("fold").agg(F.first("schema_group").alias("group")), "fold")
    folds.join(thresholds, folds["group"].eqNullSafe(thresholds["group"]), "left").drop(thresholds["group"]).write.mode("overwrite").parquet(f"{place}/folds")
    named = F.filter(F.array(*[f"pred_ch{i + 1}" for i in range(baseline.NAMED)]), lambda c: c.isNotNull())
    judged = kept.select(F.col("sample_id").alias("record"), "label", F.col("prob").alias("probability"), F.col("true_onset").alias("onset"), "predicted_onset", named.alias("predicted_channels"))
    judged = judged.join(labels.select("record", "channels"), "record")
    counts = kept.agg(F.count("*").alias("train_samples"), F.sum("label").alias("positive_samples"), F.max("fold").alias("groups"))
    metrics = evaluation.competition_metrics(judged, baseline.DECISION).crossJoin(counts)  # one row each
    metrics.withColumns({"evaluation": F.lit("each channel layout held out"), "decision_threshold": F.lit(baseline.DECISION)}).coalesce(1).write.mode("overwrite").json(f"{place}/metrics")
    baseline.fit(rows, columns).write().overwrite().save(f"{place}/model")
    onset = thresholds.agg(F.median("threshold")).first()[0]
    return _publish(spark, root, run, baseline.DECISION, onset, columns)


def predictions(features: DataFrame, track: DataFrame, ranked: DataFrame, root: str) -> DataFrame:
    """The prediction table of new records by the run in force."""
    run = latest(features.sparkSession, root)
    if run is None:
        raise ValueError(f"no run has been published in {root}")
    if run["onset_threshold"] is None:
        raise ValueError(f"run {run['run']} has no onset threshold: it was fitted without positive records in two groups")
    return baseline.predictions(features, PipelineModel.load(f"{root}/runs/{run['run']}/model"), track, ranked, run["onset_threshold"])
