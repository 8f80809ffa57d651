"""Onset analysis of labelled recordings: window features to standardised scores, and how well each score finds the onset and its channels.

features: record, channel, position (the channel's place in its record), step (from 0), t and the columns of ``spectra.FEATURES``;
onsets: record, onset in seconds, one row a record. Records without an onset are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.functions import robust
from wavequarry.operators import evaluation, network, spectra
from wavequarry.operators.onset import zscores_of

#: Features of which a fall counts like a rise; seconds of a window, and of what follows the onset or surrounds it.
TWO_SIDED = ("rms_change", "spectral_entropy_change")
WINDOW, EARLY, SEARCH_BEFORE, SEARCH_AFTER, AROUND = 0.5, 2.0, 1.0, 3.0, 5.0
#: Channels of an official list, decibels from which mains noise is severe, and clean channels that a record needs.
TOP, SEVERE, LEAST_CLEAN = 10, 20.0, 10
#: Columns of wide scores that are not scores.
KEPT = ["record", "channel", "position", "step", "t", "onset", "baseline"]
COMPOSITES = ["multiband_fast_activity", "fast_suppression_joint", "physiology_composite"]


def scores(features: DataFrame, onsets: DataFrame, propagation: bool = True) -> DataFrame:
    """record, channel, position, step, t, onset, baseline and 17 scores, with propagation 33; each on the robust scale of its baseline windows.

    A record with fewer than eight windows from ten to two seconds before its onset is an error.
    """
    x = features.join(onsets, "record").withColumn("time", F.col("t"))
    x = evaluation.baseline_windows(x, F.col("onset"), WINDOW).drop("time")
    x = zscores_of(x, ["record", "channel"], list(spectra.FEATURES), F.col("baseline"))
    z = {name: F.col(name) for name in spectra.FEATURES}
    up = lambda c: F.greatest(c, F.lit(0.0))
    multiband = F.sort_array(F.array(z["beta_power"], z["low_gamma_power"], z["high_gamma_power"]))[1]
    four = F.sort_array(F.array(up(z["line_length"]), up(z["high_low_ratio"]), up(multiband), up(z["low_frequency_suppression"])))
    x = x.withColumns({COMPOSITES[0]: multiband, COMPOSITES[1]: F.sqrt(up(multiband) * up(z["low_frequency_suppression"])), COMPOSITES[2]: (four[1] + four[2]) / 2})
    names = [*spectra.FEATURES, *COMPOSITES]
    if propagation:
        value = network.consensus(z["high_gamma_power"], z["low_frequency_suppression"], z["spectral_entropy_change"], z["kurtosis"], z["line_length"])
        spread = network.spread(x.select("record", "channel", "step", value.alias("value"))).join(x.select("record", "step", "baseline").distinct(), ["record", "step"])
        more = [*network.RECRUITMENT, *network.NETWORK.values()]
        x = x.join(network.standardised_scores(spread, more, F.col("baseline")), ["record", "channel", "step"])
        names += more
    return x.select("record", "channel", "position", "step", "t", "onset", "baseline", *[F.abs(n).alias(n) if n in TWO_SIDED else n for n in names])


def long_scores(wide: DataFrame) -> DataFrame:
    """A row for each score, with its name as ``feature`` and ``early``: whether the window ends in the two seconds from the onset on."""
    return wide.unpivot(KEPT, _score_names(wide), "feature", "score").withColumn("early", _early())


def _early() -> Column:
    return (F.col("t") >= F.col("onset")) & (F.col("t") <= F.col("onset") + EARLY)


def _score_names(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in KEPT]


def channel_responses(scores: DataFrame, official: DataFrame) -> DataFrame:
    """record, feature, feature_scope, channel, early_response, official_top10, response_rank for features that rank channels.

    scores: long, or wide as ``scores`` gives them, which moves a row a channel instead of one a score. official: record,
    channel. Equal responses rank in the order of their channels.
    """
    keys = ["record", "channel", "position"]
    if "feature" in scores.columns:
        x = scores.groupBy(*keys, "feature").agg(F.max(F.when(F.col("early"), F.col("score"))).alias("early_response"))
    else:
        names = _score_names(scores)
        x = scores.groupBy(*keys).agg(*[F.max(F.when(_early(), F.col(n))).alias(n) for n in names]).unpivot(keys, names, "feature", "early_response")
    x = x.withColumn("feature_scope", evaluation.scope(F.col("feature"))).where("feature_scope <> 'global_propagation'")
    x = x.join(official.select("record", "channel").distinct().withColumn("named", F.lit(True)), ["record", "channel"], "left")
    order = W.partitionBy("record", "feature").orderBy(F.desc("early_response"), "position")
    return x.select("record", "feature", "feature_scope", "channel", "early_response", F.coalesce("named", F.lit(False)).alias("official_top10"), F.row_number().over(order).alias("response_rank"))


def clean_channels(long: DataFrame, noise: DataFrame | None) -> DataFrame:
    """record, channel, clean: channels whose excess at the mains is at most 20 dB or not known; all, where fewer than ten would be left. noise: record, channel, line50."""
    names = long.select("record", "channel").distinct()
    if noise is None:
        return names.withColumn("clean", F.lit(True))
    x = names.join(noise.select("record", "channel", "line50"), ["record", "channel"], "left").withColumn("quiet", F.coalesce("line50", F.lit(0.0)) <= SEVERE)
    left = F.sum(F.col("quiet").cast("int")).over(W.partitionBy("record"))
    return x.select("record", "channel", (F.col("quiet") | (left < LEAST_CLEAN)).alias("clean"))


def trajectories(scores: DataFrame, clean: DataFrame | None) -> DataFrame:
    """record, feature, channel_set (all, line_clean), step, t, onset, baseline, early, channels_used, level (median-filtered 0.9 quantile over channels) and rise a second.

    scores: long, or wide as ``scores`` gives them, of which a row a window moves instead of one a score. clean: as
    ``clean_channels`` gives it; None if all channels are.
    """
    alike = ["step", "t", "onset", "baseline", "early"]
    long = "feature" in scores.columns

    def levels(x: DataFrame, channel_set: str) -> DataFrame:
        if long:
            g = x.groupBy("record", "feature", *alike).agg(_upper(F.col("score")).alias("raw"), F.count("*").alias("channels_used"))
        else:
            g = x.withColumn("early", _early()).groupBy("record", *alike).agg(*[_upper(F.col(n)).alias(n) for n in names], F.count("*").alias("channels_used"))
            g = g.unpivot(["record", *alike, "channels_used"], names, "feature", "raw")
        return g.select("record", "feature", F.lit(channel_set).alias("channel_set"), *alike, "channels_used", "raw")

    names = [] if long else _score_names(scores)
    quiet = scores if clean is None else scores.join(clean.where("clean").select("record", "channel").distinct(), ["record", "channel"], "left_semi")
    known = scores if clean is None else scores.join(clean.select("record", "channel").distinct(), ["record", "channel"], "left_semi")
    g = levels(known, "all").unionByName(levels(quiet, "line_clean").where(evaluation.family(F.col("feature")) != "propagation"))
    order = W.partitionBy("record", "feature", "channel_set").orderBy("step")
    g = g.withColumn("level", robust.median_filter3(F.col("raw"), order)).drop("raw")
    return g.withColumn("rise", (F.col("level") - F.lag("level").over(order)) / (F.col("t") - F.lag("t").over(order)))


def _upper(score: Column) -> Column:
    """``percentile(score, 0.9)`` of a group by its sorted values, which move as eight bytes each; null without values."""

    def quantile(values: Column) -> Column:
        at = F.lit(0.9) * (F.size(values) - 1)
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        a, b = F.get(values, low), F.get(values, high)
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return F.transform(F.array(F.sort_array(F.collect_list(score))), quantile)[0]


def alignment(tracks: DataFrame, responses: DataFrame) -> DataFrame:
    """One row a record, feature and channel set: time and error of the steepest rise around the onset, levels and contrast; for all channels also the overlap with the official ones and their enrichment."""
    f, t = F.col("level"), F.col("t")
    search = (t >= F.col("onset") - SEARCH_BEFORE) & (t <= F.col("onset") + SEARCH_AFTER) & F.col("rise").isNotNull()
    x = tracks.groupBy("record", "feature", "channel_set", "onset").agg(
        F.max_by(F.when(search, t), F.when(search, F.struct(F.round("rise", 9), -t))).alias("peak_change_seconds"), F.median(F.when(F.col("baseline"), f)).alias("baseline_level"),
        F.median(F.when(F.col("early"), f)).alias("early_ictal_level"), F.max("channels_used").alias("channels_used"),
    )
    error = F.col("peak_change_seconds") - F.col("onset")
    x = x.withColumns({"signed_timing_error_seconds": error, "absolute_timing_error_seconds": F.abs(error), "early_contrast": F.col("early_ictal_level") - F.col("baseline_level")})
    named, r = F.col("official_top10"), F.col("early_response")
    own = responses.groupBy("record", "feature").agg(F.sum((named & (F.col("response_rank") <= TOP)).cast("int")).alias("top10_overlap"), (F.median(F.when(named, r)) - F.median(F.when(~named, r))).alias("top10_enrichment"))
    own = own.withColumn("channel_set", F.lit("all"))
    return x.join(own, ["record", "feature", "channel_set"], "left").withColumn("feature_scope", evaluation.scope(F.col("feature")))


def around_onset(tracks: DataFrame) -> DataFrame:
    """record, feature, channel_set, relative_time_seconds, aggregate_score within five seconds of the onset."""
    away = F.col("t") - F.col("onset")
    return tracks.where(F.abs(away) <= AROUND).select("record", "feature", "channel_set", away.alias("relative_time_seconds"), F.col("level").alias("aggregate_score"))


def summary(aligned: DataFrame) -> DataFrame:
    """A row a feature over all channels' alignments: records, median and mean error, contrast, positive rate, overlap and enrichment, smallest error first."""
    e, c = F.col("absolute_timing_error_seconds"), F.col("early_contrast")
    g = aligned.where("channel_set = 'all'").groupBy("feature", "feature_scope").agg(
        F.countDistinct("record").alias("records"), F.median(e).alias("median_error"), F.avg(e).alias("mean_error"), F.median(c).alias("median_contrast"), F.avg((c > 0).cast("double")).alias("positive_rate"),
        F.avg("top10_overlap").alias("mean_overlap"), F.median("top10_enrichment").alias("median_enrichment"),
    )
    return g.orderBy("median_error", "feature")
