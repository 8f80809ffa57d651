"""Rules of scopes, baselines, auxiliary channels and folds on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import evaluation


def test_scopes_and_best_feature(spark):
    names = ["lagged_outflow", "coactivation_strength", "network_density", "log_rms"]
    x = spark.createDataFrame([(n, s) for n, s in zip(names, (0.5, 0.5, 0.9, 0.8))], "feature string, score double")
    got = {r.feature: (r.s, r.f) for r in x.select("feature", evaluation.scope(F.col("feature")).alias("s"), evaluation.family(F.col("feature")).alias("f")).collect()}
    assert got == {names[0]: ("channel_propagation", "propagation"), names[1]: ("channel_propagation", "propagation"), names[2]: ("global_propagation", "propagation"), names[3]: ("channel_local", "round1")}
    assert [r.feature for r in evaluation.best_channel_propagation(x, "score").collect()] == ["coactivation_strength"]
    both = evaluation.before_and_after(x, x.where("score > 0.6"), ["score"]).collect()
    assert {r.feature: r.score_after for r in both} == {names[0]: None, names[1]: None, names[2]: 0.9, names[3]: 0.8}


def test_channels(spark):
    rows = [("r", 2, "POL A2"), ("r", 0, "POL A1-Ref"), ("r", 1, "POL DC01"), ("r", 3, "POL AC12"), ("r", 4, "other"), ("r", 5, None)]
    x = spark.createDataFrame(rows, "record string, position int, label string")
    # names of the current family also parse as contacts
    assert [r.position for r in evaluation.neural_channels(x).collect()] == [0, 2, 3]
    assert sorted(r.position for r in evaluation.auxiliary_channels(x).collect()) == [1, 3]
    samples = [0.0, 366.3, 732.6, 100.0, 0.0, 0.0]  # the share is one of levels, not of samples
    y = spark.createDataFrame([(samples,), ([],)], "v array<double>").select(*[c.alias(k) for k, c in evaluation.auxiliary_metrics(F.col("v")).items()]).collect()
    assert (y[0].levels, y[0].least, y[0].most, y[0].step_rate) == (4, 0.0, 732.6, 0.75)
    assert y[0].deviation == pytest.approx(np.std(samples))
    assert y[1].deviation is None and y[1].step_rate is None


def test_baseline_windows(spark):
    x = spark.createDataFrame([("a", k / 2) for k in range(60)], "record string, time double")
    got = evaluation.baseline_windows(x, F.lit(12.0), 4.0).where("baseline").agg(F.min("time"), F.max("time"), F.count("*")).first()
    assert tuple(got) == (4.0, 10.0, 13)
    with pytest.raises(Exception, match="fewer than 8 baseline windows: a"):
        evaluation.baseline_windows(x, F.lit(6.0), 4.0).collect()
    early = evaluation.early_response(x.select("record", F.lit(1).alias("channel"), F.col("time").alias("score")), F.col("score") < 3).first()
    assert early.response == 2.5
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "record string, label int")
    assert evaluation.positive_records(spark.createDataFrame([("a",), ("b",)], "record string"), labels).first().record == "b"


def test_metrics_of_missed_and_empty_tables(spark):
    schema = "label int, probability double, onset double, predicted_onset double, channels array<string>, predicted_channels array<string>"
    rows = [(1, 0.9, 10.0, 13.0, list("abcdefghij"), list("abcdefghij")), (1, 0.1, 10.0, 10.0, list("abcdefghij"), list("abcdefghij")), (0, 0.2, None, 5.0, [], list("ab"))]
    got = evaluation.competition_metrics(spark.createDataFrame(rows, schema), 0.5).first()
    assert (got.auc, got.sensitivity, got.specificity, got.channel_overlap, got.channel_rank_proxy) == (0.5, 0.5, 1.0, 0.5, pytest.approx(0.5))
    assert got.f1 == pytest.approx(2 / 3) and got.onset_mae == 31.5 and got.onset_score == pytest.approx(1 - 31.5 / 60)
    assert got.score_overlap_proxy == pytest.approx(0.25 * 0.5 + 0.15 * 2 / 3 + 0.05 + 0.1 + 0.15 * got.onset_score + 0.125)
    assert evaluation.competition_metrics(spark.createDataFrame([], schema), 0.5).first().auc is None
