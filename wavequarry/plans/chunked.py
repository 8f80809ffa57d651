"""Queries on chunked signals and containers; embeddings stand for recordings (label: record, vec_id: channel), cut into chunks of 12 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequarry.functions import arrays
from wavequarry.operators import chunks
from wavequarry.plans.lookups import r6, table
from wavequarry.sources import ranged, shared

SIZE, KEYS = 12, ["record", "channel"]


def _channels(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "embeddings").select(F.col("label").alias("record"), F.col("vec_id").alias("channel"), F.col("embedding").alias("samples"))


def chunked_window_kernels(spark, d):  # noqa: ANN001, ANN201
    """Kernels of windows of 20 samples every 6, which cross one or two borders of chunks."""
    x = chunks.windows(chunks.cut(_channels(spark, d), SIZE), KEYS, SIZE, 20, 6).withColumn("c", arrays.centred(F.col("x")))
    c = F.col("c")
    return x.select("record", "channel", "w", r6(arrays.line_length(c)).alias("line_length"), r6(arrays.rms(c)).alias("rms"), r6(arrays.kurtosis(c)).alias("kurtosis"))


def chunked_density(spark, d):  # noqa: ANN001, ANN201
    """Decibels of the mean power density over half-overlapping segments of 16 samples."""
    x = chunks.density(chunks.cut(_channels(spark, d), SIZE), KEYS, SIZE, 64.0, 16, 8)
    return x.where("bin > 0").select("channel", "bin", r6("frequency").alias("frequency"), F.round(10 * F.log10("power"), 5).alias("decibels"))


def chunked_profile(spark, d):  # noqa: ANN001, ANN201
    """Counts, rates, moments and ends of every record's samples, from a state a chunk."""
    x = chunks.profile(chunks.cut(_channels(spark, d), SIZE), KEYS, ["record"])
    return x.select("record", "channels", "samples", *[r6(c).alias(c) for c in x.columns[3:]])


def auxiliary_channel_metrics(spark, d):  # noqa: ANN001, ANN201
    """Levels, whole steps, range, run lengths and transitions of channels whose samples are rounded down to eighths."""
    own = _channels(spark, d).withColumn("samples", F.transform("samples", lambda v: F.floor(v.cast("double") * 8).cast("double")))
    x = chunks.auxiliary_metrics(chunks.cut(own, SIZE), KEYS, 2.0)
    return x.select("record", "channel", "levels", "least", "most", "median_run", *[r6(c).alias(c) for c in ("step_rate", "std", "transition_rate")])


def chunked_notches(spark, d):  # noqa: ANN001, ANN201
    """Signals at 400 Hz without 50, 100 and 150 Hz, filtered to and fro across chunks: samples, level and ends of every chunk."""
    x = chunks.notched(chunks.cut(_channels(spark, d), SIZE), KEYS, SIZE, 400.0)
    level = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples"))
    return x.select("record", "channel", "chunk", F.size("samples").alias("n"), r6(level).alias("rms"), r6(F.col("samples")[0]).alias("first"), r6(F.element_at("samples", -1)).alias("last"))


def container_round_trip(spark, d):  # noqa: ANN001, ANN201
    """Every record written as a container, and its channels from the third on read back in chunks of 24 samples."""
    folder = shared.folder(spark)
    e = table(spark, d, "embeddings").where("label is not null and embedding is not null")
    e = e.select(F.concat(F.lit("train_"), F.col("label")).alias("sample_id"), F.col("vec_id").cast("int").alias("channel_index"), F.concat(F.lit("POL A"), F.col("vec_id")).alias("channel_id"), F.col("embedding").alias("signal"))
    written = shared.stored(ranged.write(e, f"{folder}/containers", 64.0), folder, "written")
    x = ranged.read(spark, f"{folder}/containers", "chunks", chunkSamples=24, partBytes=1 << 16).where("channel_index >= 2")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    own = x.groupBy("sample_id", "channel_id").agg(F.max("channel_index").alias("position"), F.max("raw_channel_index").alias("raw"), F.count("*").alias("chunks"), F.sum(F.size("samples")).alias("samples"), F.sum(total(F.col("samples"))).alias("total"))
    return own.join(written.select("sample_id", "n_channels"), "sample_id").select("sample_id", "channel_id", "position", "raw", "n_channels", "chunks", "samples", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (chunked_window_kernels, chunked_density, chunked_profile, chunked_notches, auxiliary_channel_metrics, container_round_trip)}

_E = "e AS (SELECT label AS record, vec_id AS channel, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_L = "l AS (SELECT record, channel, i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM e))"
_PART = "list_sum(list_transform(range(16), lambda i: (s[i + 1] - list_sum(s) / 16) * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * {f}(2 * pi() * bin * i / 16)))"

# a filter begun at rest answers x as the sum of h[k] * x[n - k], the first value standing for all that were before
_TO = "list_transform(range(1, len(x) + 1), lambda n: list_sum(list_transform(range(n), lambda k: h[k + 1] * x[n - k])) + (1 - list_sum(h[1:n])) * x[1])"
_NOTCHED = ", ".join(
    f"""w{k} AS (SELECT record, channel, h, list_concat(list_transform(range(9), lambda i: 2 * x[1] - x[10 - i]), x, list_transform(range(9), lambda i: 2 * x[len(x)] - x[len(x) - 1 - i])) AS x FROM {source}, h WHERE line = {50 * k}),
    t{k} AS (SELECT record, channel, h, list_reverse({_TO}) AS x FROM w{k}), b{k} AS (SELECT record, channel, list_reverse({_TO}) AS x FROM t{k}), n{k} AS (SELECT record, channel, x[10 : len(x) - 9] AS x FROM b{k})"""
    for k, source in ((1, "e"), (2, "n1"), (3, "n2"))
)

ORACLES = {
    "chunked_notches": f"""WITH RECURSIVE {_E}, f AS (SELECT line, 1 / (1 + tan(pi() * line / 400 / 50)) AS g, cos(2 * pi() * line / 400) AS c FROM (VALUES (50), (100), (150)) v(line)),
        s(line, g, c, k, h, before) AS (SELECT line, g, c, 0, g, 0.0::DOUBLE FROM f UNION ALL
        SELECT line, g, c, k + 1, 2 * g * c * h - (2 * g - 1) * before + (CASE k WHEN 0 THEN -2 * g * c WHEN 1 THEN g ELSE 0 END), h FROM s WHERE k < (SELECT max(len(x)) + 18 FROM e)),
        h AS (SELECT line, list(h ORDER BY k) AS h FROM s GROUP BY line), {_NOTCHED}, c AS (SELECT record, channel, chunk, x[12 * chunk + 1 : 12 * chunk + 12] AS x FROM (SELECT *, unnest(range(CAST(ceil(len(x) / 12.0) AS BIGINT))) AS chunk FROM n3))
        SELECT record, channel, CAST(chunk AS INT) AS chunk, CAST(len(x) AS INT) AS n, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms, round(x[1], 6) AS first, round(x[len(x)], 6) AS last FROM c""",
    "chunked_window_kernels": f"""WITH {_E}, w AS (SELECT record, channel, w, x[6 * w + 1 : 6 * w + 20] AS x FROM e, range(11) r(w) WHERE 6 * w + 20 <= len(x)),
        c AS (SELECT record, channel, w, list_transform(x, lambda v: v - list_sum(x) / 20) AS c FROM w)
        SELECT record, channel, CAST(w AS INT) AS w, round(list_sum(list_transform(range(1, 20), lambda i: abs(c[i + 1] - c[i]))) / 19, 6) AS line_length, round(sqrt(list_sum(list_transform(c, lambda v: v * v)) / 20), 6) AS rms,
        round(list_sum(list_transform(c, lambda v: v * v * v * v)) / 20 / greatest((list_sum(list_transform(c, lambda v: v * v)) / 20) ** 2, 1.1754943508222875e-38), 6) AS kurtosis FROM c""",
    "chunked_density": f"""WITH {_E}, s AS (SELECT channel, x[8 * k + 1 : 8 * k + 16] AS s FROM e, range(7) r(k)), b AS (SELECT channel, bin, ({_PART.format(f='cos')}) ** 2 + ({_PART.format(f='sin')}) ** 2 AS p FROM s, range(1, 9) r(bin))
        SELECT channel, CAST(bin AS INT) AS bin, round(bin * 4.0::DOUBLE, 6) AS frequency, round(10 * log10((CASE WHEN bin < 8 THEN 2 ELSE 1 END) * avg(p) / (64 * 6)), 5) AS decibels FROM b GROUP BY channel, bin""",
    "chunked_profile": f"""WITH {_E}, {_L}, f AS (SELECT * FROM l WHERE isfinite(v))
        SELECT l.record, count(DISTINCT channel) AS channels, count(*) AS samples, round(any_value(n) / CAST(count(*) AS DOUBLE), 6) AS finite_rate, round(avg(CAST(v = 0 AS DOUBLE)), 6) AS zero_rate, round(any_value(m), 6) AS mean, round(any_value(s), 6) AS std,
        round(any_value(lo), 6) AS least, round(any_value(hi), 6) AS most, round(arg_min(v, (channel, i)), 6) AS first, round(arg_max(v, (channel, i)), 6) AS last
        FROM l JOIN (SELECT record, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM f GROUP BY record) USING (record) GROUP BY l.record""",
    "auxiliary_channel_metrics": f"""WITH {_E}, {_L}, q AS (SELECT record, channel, i, floor(v * 8) AS v FROM l),
        n AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY record, channel ORDER BY i)),
        k AS (SELECT *, sum(new) OVER (PARTITION BY record, channel ORDER BY i) AS run FROM n),
        r AS (SELECT record, channel, median(m) AS median_run FROM (SELECT record, channel, run, count(*) AS m FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT record, channel, count(DISTINCT v) AS levels, min(v) AS least, max(v) AS most, any_value(median_run) AS median_run, round(count(DISTINCT v) FILTER (v % 2 = 0) / CAST(count(DISTINCT v) AS DOUBLE), 6) AS step_rate,
        round(stddev_pop(v), 6) AS std, round(CAST(sum(new) - 1 AS DOUBLE) / (count(*) - 1), 6) AS transition_rate FROM k JOIN r USING (record, channel) GROUP BY 1, 2""",
    "container_round_trip": """WITH c AS (SELECT 'train_' || label AS sample_id, 'POL A' || vec_id AS channel_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS position, CAST(vec_id AS INT) AS raw,
        CAST(count(*) OVER (PARTITION BY label) AS INT) AS n_channels, embedding AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
        SELECT sample_id, channel_id, position, raw, n_channels, CAST(ceil(len(x) / 24.0) AS BIGINT) AS chunks, CAST(len(x) AS BIGINT) AS samples, round(list_sum(CAST(x AS DOUBLE[])), 4) AS total FROM c WHERE position >= 2""",
}
