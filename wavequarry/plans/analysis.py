"""Onset analysis over embeddings: label is the record, vec_id the channel, positions are windows; feature k of a window is the sample k places on, going round."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.operators import analysis, spectra
from wavequarry.plans.lookups import r6, table
from wavequarry.sources import shared

ALL = [*spectra.FEATURES, *analysis.COMPOSITES]


def _scores(spark, d):  # noqa: ANN001, ANN202
    e = table(spark, d, "embeddings").where("size(embedding) > 0").select(F.col("label").alias("record"), F.col("vec_id").alias("channel"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    onsets = e.select("record").distinct().withColumn("onset", 5.0 + F.col("record") * 0.125)
    e = e.withColumns({"n": F.size("x"), "position": F.col("channel"), "step": F.explode(F.sequence(F.lit(0), F.size("x") - 1))})
    at = [F.col("x")[F.pmod(F.col("step") + k, F.col("n"))].alias(name) for k, name in enumerate(spectra.FEATURES)]
    features = e.select("record", "channel", "position", "step", (0.5 + F.col("step") * 0.125).alias("t"), *at)
    return analysis.scores(features, onsets, propagation=False)


def _official(spark, d):  # noqa: ANN001, ANN202
    """Ten channels of each record: those of the smallest numbers."""
    e = table(spark, d, "embeddings").where("size(embedding) > 0").select(F.col("label").alias("record"), F.col("vec_id").alias("channel"))
    return e.withColumn("i", F.row_number().over(W.partitionBy("record").orderBy("channel"))).where("i <= 10").select("record", "channel")


def onset_channel_responses(spark, d):  # noqa: ANN001, ANN201
    """Early response of every channel to every score, its rank and whether it is among the record's official ten."""
    x = analysis.channel_responses(_scores(spark, d), _official(spark, d))
    return x.select("record", "feature", "channel", r6("early_response").alias("early_response"), "official_top10", "response_rank")


def onset_alignment_scores(spark, d):  # noqa: ANN001, ANN201
    """Error of the steepest rise, levels, contrast, overlap and enrichment for each record and each of seventeen scores."""
    wide = shared.stored(_scores(spark, d), shared.folder(spark), "scores")  # both halves read them
    x = analysis.alignment(analysis.trajectories(wide, None).where("channel_set = 'all'"), analysis.channel_responses(wide, _official(spark, d)))
    return x.select("record", "feature", "feature_scope", "peak_change_seconds", "absolute_timing_error_seconds", "channels_used", "top10_overlap", *[r6(c).alias(c) for c in ("baseline_level", "early_ictal_level", "early_contrast", "top10_enrichment")])


QUERIES = {f.__name__: f for f in (onset_channel_responses, onset_alignment_scores)}

_FEATURES = f"""e AS (SELECT label AS record, vec_id AS channel, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0),
    f AS (SELECT record, channel, step, 0.5::DOUBLE + step * 0.125::DOUBLE AS t, 5.0::DOUBLE + record * 0.125::DOUBLE AS onset, {', '.join(f'x[(step + {k}) % len(x) + 1] AS {n}' for k, n in enumerate(spectra.FEATURES))} FROM (SELECT *, unnest(range(len(x))) AS step FROM e)),
    l AS (SELECT *, t >= greatest(0.5, onset - 10) AND t <= onset - 2 AS base, t >= onset AND t <= onset + 2 AS early FROM (UNPIVOT f ON {', '.join(spectra.FEATURES)} INTO NAME feature VALUE v)),
    c AS (SELECT *, median(v) FILTER (base) OVER w AS mid, stddev_pop(v) FILTER (base) OVER w AS s FROM l WINDOW w AS (PARTITION BY record, channel, feature)),
    d AS (SELECT *, 1.4826::DOUBLE * median(abs(v - mid)) FILTER (base) OVER (PARTITION BY record, channel, feature) AS mad FROM c),
    z AS (SELECT record, channel, step, t, onset, base, early, feature, (v - mid) / greatest(CASE WHEN mad > 1e-6 THEN mad ELSE s END, 1e-6) AS z FROM d),
    w AS (SELECT record, channel, step, t, onset, base, early, {', '.join(f"any_value(z) FILTER (feature = '{n}') AS {n}" for n in spectra.FEATURES)} FROM z GROUP BY ALL),
    m AS (SELECT *, list_sort([beta_power, low_gamma_power, high_gamma_power])[2] AS multiband_fast_activity FROM w),
    q AS (SELECT *, list_sort([greatest(line_length, 0), greatest(high_low_ratio, 0), greatest(multiband_fast_activity, 0), greatest(low_frequency_suppression, 0)]) AS four FROM m),
    wide AS (SELECT * EXCLUDE (four) REPLACE (abs(rms_change) AS rms_change, abs(spectral_entropy_change) AS spectral_entropy_change), sqrt(greatest(multiband_fast_activity, 0) * greatest(low_frequency_suppression, 0)) AS fast_suppression_joint, (four[2] + four[3]) / 2 AS physiology_composite FROM q),
    long AS (UNPIVOT wide ON {', '.join(ALL)} INTO NAME feature VALUE score),
    named AS (SELECT record, channel FROM e QUALIFY row_number() OVER (PARTITION BY record ORDER BY channel) <= 10),
    r AS (SELECT record, feature, channel, max(score) FILTER (early) AS response FROM long GROUP BY 1, 2, 3),
    k AS (SELECT *, (record, channel) IN (SELECT (record, channel) FROM named) AS official, row_number() OVER (PARTITION BY record, feature ORDER BY response DESC, channel) AS rank FROM r)"""

ORACLES = {
    "onset_channel_responses": f"WITH {_FEATURES} SELECT record, feature, channel, round(response, 6) AS early_response, official AS official_top10, CAST(rank AS INT) AS response_rank FROM k",
    "onset_alignment_scores": f"""WITH {_FEATURES}, g AS (SELECT record, feature, step, t, onset, base, early, quantile_cont(score, 0.9) AS y, count(*) AS n FROM long GROUP BY ALL),
        h AS (SELECT *, coalesce(lag(y) OVER o, y) AS a, coalesce(lead(y) OVER o, y) AS b FROM g WINDOW o AS (PARTITION BY record, feature ORDER BY step)),
        i AS (SELECT * EXCLUDE (y), list_sort([a, y, b])[2] AS y FROM h), j AS (SELECT *, (y - lag(y) OVER o) / (t - lag(t) OVER o) AS rise FROM i WINDOW o AS (PARTITION BY record, feature ORDER BY step)),
        p AS (SELECT record, feature, onset, arg_max(t, {{'r': round(rise, 9), 't': -t}}) FILTER (t >= onset - 1 AND t <= onset + 3 AND rise IS NOT NULL) AS peak, median(y) FILTER (base) AS lo, median(y) FILTER (early) AS hi, max(n) AS n FROM j GROUP BY ALL),
        o AS (SELECT record, feature, count(*) FILTER (official AND rank <= 10) AS overlap, median(response) FILTER (official) - median(response) FILTER (NOT official) AS enrichment FROM k GROUP BY 1, 2)
        SELECT record, feature, 'channel_local' AS feature_scope, peak AS peak_change_seconds, abs(peak - onset) AS absolute_timing_error_seconds, n AS channels_used, overlap AS top10_overlap, round(lo, 6) AS baseline_level, round(hi, 6) AS early_ictal_level,
        round(hi - lo, 6) AS early_contrast, round(enrichment, 6) AS top10_enrichment FROM p JOIN o USING (record, feature)""",
}
