"""Evaluation of predictions, anomaly evidence of frames, scopes of features and bookkeeping of folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavequarry.functions import naming, robust
from wavequarry.operators import ranks

#: Names of features that describe a whole recording's spread, and of those that rank its channels.
GLOBAL_PROPAGATION = ("recruited_fraction_2z", "recruited_fraction_3z", "recruitment_fraction_slope", "recruitment_dispersion", "propagation_front", "network_density", "largest_component_fraction", "mean_lagged_connectivity")
CHANNEL_PROPAGATION = ("recruitment_consensus", "recruitment_persistence", "recruitment_change_rate", "early_recruitment_lead", "propagation_participation", "lagged_outflow", "net_lagged_outflow", "coactivation_strength")
#: Frames of the baseline, the least scale of evidence, the step of an auxiliary input, and the windows a baseline needs.
BASELINE_FRAMES, EVIDENCE_FLOOR, INPUT_STEP, LEAST_WINDOWS = 10, 0.15, 366.3, 8


def scope(feature: Column) -> Column:
    """What a feature can say: timing of the whole recording, or ranks of channels."""
    return F.when(feature.isin(*GLOBAL_PROPAGATION), "global_propagation").when(feature.isin(*CHANNEL_PROPAGATION), "channel_propagation").otherwise("channel_local")


def family(feature: Column) -> Column:
    return F.when(feature.isin(*GLOBAL_PROPAGATION, *CHANNEL_PROPAGATION), "propagation").otherwise("round1")


def best_channel_propagation(summary: DataFrame, score: str) -> DataFrame:
    """The feature of the best score among those that rank channels by propagation; the first name of equals."""
    return summary.where(scope(F.col("feature")) == "channel_propagation").orderBy(F.desc(score), "feature").limit(1)


def before_and_after(before: DataFrame, after: DataFrame, measures: list[str]) -> DataFrame:
    """Every feature of the first summary with the second one's measures beside its own; null where it has none."""
    return before.join(after.select("feature", *[F.col(m).alias(f"{m}_after") for m in measures]), "feature", "left")


def neural_channels(channels: DataFrame) -> DataFrame:
    """The channels that may be electrode contacts, by record and position (record, position, label)."""
    return channels.where(naming.role(F.col("label")) == "seeg_candidate").orderBy("record", "position")


def auxiliary_channels(channels: DataFrame) -> DataFrame:
    """Direct-current inputs and the alternating-current family."""
    return channels.where((naming.role(F.col("label")) == "auxiliary_dc") | F.col("label").rlike(naming.CURRENT_FAMILY))


def auxiliary_metrics(samples: Column) -> dict[str, Column]:
    """Levels, range, deviation and the share of levels that are whole steps, of one auxiliary channel's array of samples; null where it is empty."""
    n = F.nullif(F.size(samples), F.lit(0))
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / n
    levels = F.array_distinct(samples)
    whole = F.filter(levels, lambda x: F.abs(x / INPUT_STEP - F.rint(x / INPUT_STEP)) <= 2e-3 + 1e-5 * F.abs(F.rint(x / INPUT_STEP)))
    return {
        "levels": F.size(levels),
        "least": F.array_min(samples),
        "most": F.array_max(samples),
        "deviation": F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n),
        "step_rate": F.size(whole) / F.nullif(F.size(levels), F.lit(0)),
    }


def positive_records(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files of recordings that are labelled 1."""
    return files.join(labels.where("label = 1"), "record")


def baseline_windows(windows: DataFrame, onset: Column, length: float, reach: float = 10.0, guard: float = 2.0) -> DataFrame:
    """Adds ``baseline`` to windows (record, time): from ``reach`` seconds before the onset, but not before a full window, to ``guard`` before it.

    A record with fewer than eight such windows is an error that names it. They are counted apart, so that no task has to
    hold all windows of a record.
    """
    inside = (F.col("time") >= F.greatest(F.lit(length), onset - reach)) & (F.col("time") <= onset - guard)
    counts = windows.groupBy(F.col("record").alias("_record")).agg(F.sum(inside.cast("int")).alias("_n"))
    short = F.raise_error(F.concat(F.lit("fewer than 8 baseline windows: "), F.col("record").cast("string")))
    counted = windows.join(counts, F.col("record").eqNullSafe(F.col("_record")))
    return counted.withColumn("baseline", F.when(F.col("_n") < LEAST_WINDOWS, short.cast("boolean")).otherwise(inside)).drop("_record", "_n")


def early_response(scores: DataFrame, early: Column) -> DataFrame:
    """The highest score of each record's channel among early windows."""
    return scores.groupBy("record", "channel").agg(F.max(F.when(early, F.col("score"))).alias("response"))


def evidence(maps: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``evidence`` to frames (record, channel, step): mean of the features on the robust scale of the first ten frames, zero at least."""
    whole = W.partitionBy("record", "channel")
    first = F.col("step") < BASELINE_FRAMES
    centred = maps.withColumns({f"_{f}": F.col(f) - F.median(F.when(first, F.col(f))).over(whole) for f in features})
    scaled = [F.col(f"_{f}") / F.greatest(F.lit(robust.MAD_FACTOR) * F.median(F.when(first, F.abs(F.col(f"_{f}")))).over(whole), F.lit(EVIDENCE_FLOOR)) for f in features]
    mean = sum(scaled[1:], scaled[0]) / len(features)
    return centred.withColumn("evidence", F.greatest(mean, F.lit(0.0))).drop(*[f"_{f}" for f in features])


def anomaly_track(frames: DataFrame) -> DataFrame:
    """record, step, level: the 0.9 quantile of the channels' evidence, smoothed over three steps."""
    track = frames.groupBy("record", "step").agg(F.percentile("evidence", 0.9).alias("level"))
    return track.withColumn("level", robust.mean3_padded(F.col("level"), W.partitionBy("record").orderBy("step")))


def anomaly_summaries(frames: DataFrame) -> DataFrame:
    """One row a record: largest of its smoothed trajectory, and median, 0.9 quantile and mean after the first ten frames."""
    track = anomaly_track(frames)
    later = F.when(F.col("step") >= BASELINE_FRAMES, F.col("level"))
    return track.groupBy("record").agg(F.max("level").alias("anomaly_max"), F.median(later).alias("anomaly_median"), F.percentile(later, 0.9).alias("anomaly_q90"), F.avg(later).alias("anomaly_auc"))


def anomaly_channels(frames: DataFrame) -> DataFrame:
    """Score of every channel: the 0.9 quantile of its evidence after the first ten frames."""
    return frames.where(F.col("step") >= BASELINE_FRAMES).groupBy("record", "channel").agg(F.percentile("evidence", 0.9).alias("score"))


def fold_counts(rows: DataFrame, fold: str, label: str) -> DataFrame:
    """Rows and positive rows of every fold, and those that are left to learn from."""
    g = rows.groupBy(fold).agg(F.count("*").alias("held"), F.sum(F.col(label).cast("int")).alias("held_positive"))
    total = rows.agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("int")).alias("_p"))
    return g.crossJoin(F.broadcast(total)).select(fold, "held", "held_positive", (F.col("_n") - F.col("held")).alias("learned"), (F.col("_p") - F.col("held_positive")).alias("learned_positive"))


def rank_score(truth: Column, predicted: Column) -> Column:
    """Discounted agreement of two ranked lists, one for equal lists."""

    def gain(x: Column, i: Column, at: Column) -> Column:
        return F.when(at > 0, 1 / (F.log2(i + 2.0) * F.log2(at + 1.0))).otherwise(0.0)

    got = F.aggregate(F.transform(truth, lambda x, i: gain(x, i, F.array_position(predicted, x))), F.lit(0.0), lambda a, x: a + x)
    best = F.aggregate(F.transform(truth, lambda x, i: 1 / (F.log2(i + 2.0) * F.log2(i + 2.0))), F.lit(0.0), lambda a, x: a + x)
    return got / F.nullif(best, F.lit(0.0))


def competition_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    """One row of metrics over predictions (label, probability, onset, predicted_onset, channels, predicted_channels).

    A missed recording counts as an error of 60 seconds and no channel. AUC takes average ranks over distinct
    probabilities; without either class the measures that need it are null.
    """
    positive, hit = F.col("label") == 1, F.col("probability") >= threshold
    found = positive & hit
    share = F.size(F.array_intersect("predicted_channels", "channels")) / 10.0
    per_value = rows.groupBy("probability").agg(
        F.sum(positive.cast("long")).alias("p"),
        F.count("*").alias("n"),
        F.sum(found.cast("long")).alias("tp"),
        F.sum((~positive & hit).cast("long")).alias("fp"),
        F.sum(F.when(found, F.abs(F.col("predicted_onset") - F.col("onset"))).when(positive, 60.0)).alias("error"),
        F.sum(F.when(found, share)).alias("overlap"),
        F.sum(F.when(found, rank_score(F.col("channels"), F.col("predicted_channels")))).alias("rank"),
    )
    t = ranks.sums_before(per_value, "probability", ["n"]).withColumn("at", F.col("n_before") + (F.col("n") + 1) / 2).agg(
        F.sum(F.col("p") * F.col("at")).alias("r"), *[F.sum(c).cast("double").alias(c) for c in ("p", "n", "tp", "fp")], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("error", "overlap", "rank")]
    )
    n1, n0 = F.nullif(F.col("p"), F.lit(0.0)), F.nullif(F.col("n") - F.col("p"), F.lit(0.0))
    m = t.select(
        ((F.col("r") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"),
        F.coalesce(2 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp") + F.col("p"), F.lit(0.0)), F.lit(0.0)).alias("f1"),
        (F.col("tp") / n1).alias("sensitivity"),
        (1 - F.col("fp") / n0).alias("specificity"),
        (F.col("overlap") / n1).alias("channel_overlap"),
        (F.col("rank") / n1).alias("channel_rank_proxy"),
        (F.col("error") / n1).alias("onset_mae"),
    ).withColumn("onset_score", F.greatest(F.lit(0.0), 1 - F.col("onset_mae") / 60))
    base = F.expr("0.25D * auc + 0.15D * f1 + 0.10D * sensitivity + 0.10D * specificity + 0.15D * onset_score")
    return m.withColumns({"score_overlap_proxy": base + F.lit(0.25) * F.col("channel_overlap"), "score_rank_proxy": base + F.lit(0.25) * F.col("channel_rank_proxy")})
