"""The onset chain on a recording whose channels turn from slow to fast at a known time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import naming
from wavequarry.operators import analysis, evaluation, spectra


@pytest.fixture(scope="module")
def recording():
    rate, onset = 2000, 5.0
    rng = np.random.default_rng(20260810)
    t = np.arange(16_000) / rate
    x = rng.normal(scale=0.15, size=(13, len(t)))
    for k in range(10):
        x[k] += np.where(t < onset, np.sin(2 * np.pi * 5 * t), 2 * np.sin(2 * np.pi * 100 * t + 0.1 * k))
    x[12] = t > onset
    return [("N4", f"POL A{k + 1}" if k < 12 else "POL DC01", k, v.tolist()) for k, v in enumerate(x)]


def test_onset_chain(spark, recording):
    channels = spark.createDataFrame(recording, "record string, channel string, position int, samples array<double>").where(naming.role(F.col("channel")) == "seeg_candidate")
    features = spectra.features(channels, 2000.0).withColumn("step", F.round((F.col("t") - 0.5) / 0.125).cast("int"))
    assert features.select("channel").distinct().count() == 12 and features.agg(F.min("t")).first()[0] == 0.5
    onsets = spark.createDataFrame([("N4", 5.0)], "record string, onset double")
    wide = analysis.scores(features, onsets).cache()
    assert len(wide.columns) - 7 == 33 and len(analysis.scores(features, onsets, propagation=False).columns) - 7 == 17
    long = analysis.long_scores(wide)
    official = spark.createDataFrame([("N4", f"POL A{k}") for k in range(1, 11)], "record string, channel string")
    noise = spark.createDataFrame([("N4", "POL A12", 25.0)], "record string, channel string, line50 double")
    responses = analysis.channel_responses(long, official)
    tracks = analysis.trajectories(long, analysis.clean_channels(long, noise))
    aligned = analysis.alignment(tracks, responses).cache()
    got = {(r.feature, r.channel_set): r for r in aligned.collect()}
    assert len(got) == 33 + 17
    best = got["high_gamma_power", "all"]
    assert best.absolute_timing_error_seconds <= 0.5 and best.early_contrast > 0.25 and best.top10_overlap == 10 and best.channels_used == 12
    assert got["high_gamma_power", "line_clean"].channels_used == 11 and got["high_gamma_power", "line_clean"].top10_overlap is None
    assert got["network_density", "all"].top10_overlap is None and got["network_density", "all"].feature_scope == "global_propagation"
    assert responses.where("feature = 'high_gamma_power'").count() == 12 and responses.where("feature = 'network_density'").count() == 0
    assert responses.select("feature").distinct().count() == 33 - len(evaluation.GLOBAL_PROPAGATION)
    around = analysis.around_onset(tracks.where("feature = 'high_gamma_power' and channel_set = 'all'")).agg(F.min("relative_time_seconds"), F.max("relative_time_seconds")).first()
    assert around[0] == -4.5 and around[1] == 3.0
    assert analysis.summary(aligned).count() == 33
    with pytest.raises(Exception, match="fewer than 8 baseline windows: N4"):
        analysis.scores(features, onsets.withColumn("onset", F.lit(2.0)), propagation=False).collect()


def test_wide_scores_give_what_long_ones_do_with_few_passes(spark):
    wide = spark.range(40).selectExpr("id % 2 record", "id % 4 channel", "id % 4 position", "id div 4 step", "0.5 + (id div 4) * 0.5 t", "3.0d onset", "id < 20 baseline", "cast(hash(id) as double) log_rms", "if(id % 3 = 0 or id div 4 = 2, null, id / 7d) lagged_outflow")
    long = analysis.long_scores(wide)
    official = spark.createDataFrame([(0, 0), (1, 3)], "record long, channel long")
    noise = spark.createDataFrame([(0, 2, 25.0)], "record long, channel long, line50 double")
    clean = analysis.clean_channels(long, noise).withColumn("clean", F.col("channel") != 2)
    rows = lambda x: sorted(map(repr, x.select(sorted(x.columns)).collect()))
    assert rows(analysis.trajectories(wide, clean)) == rows(analysis.trajectories(long, clean))
    assert rows(analysis.channel_responses(wide, official)) == rows(analysis.channel_responses(long, official))
    every = clean.withColumn("clean", F.lit(True))
    assert rows(analysis.trajectories(wide, None)) == rows(analysis.trajectories(long, every))
    raw = long.groupBy("record", "feature", "step").agg(F.percentile("score", 0.9).alias("p"), analysis._upper(F.col("score")).alias("q"))
    assert raw.where("not p <=> q").count() == 0 and raw.where("q is null").count() > 0

    windows = spark.range(80).selectExpr("id % 2 record", "id % 4 channel", "id % 4 position", "id div 4 step", "0.5 + (id div 4) * 0.5 t", *[f"cast(hash(id, {k}) as double) {n}" for k, n in enumerate(spectra.FEATURES)])
    onsets = spark.createDataFrame([(0, 8.0), (1, 8.0)], "record long, onset double")
    plan = analysis.scores(windows, onsets, propagation=False)._jdf.queryExecution().optimizedPlan().toString()
    # two passes over a channel; nothing needs all windows of a record in one task
    assert sum(line.lstrip("+-: |").startswith("Window ") for line in plan.splitlines()) == 2
