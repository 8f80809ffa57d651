"""Signal queries with the embeddings table as recordings: label is the record, vec_id the channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequarry.functions import arrays
from wavequarry.operators import onset, pairs
from wavequarry.plans.lookups import r6, table


def _windows(spark, d, length, step):  # noqa: ANN001, ANN202
    """Full windows of each channel, cut by array index; t is the window's end as a share of the recording."""
    n = (64 - length) // step + 1
    e = table(spark, d, "embeddings").select(F.col("label").alias("record"), "vec_id", arrays.doubles(F.col("embedding")).alias("x"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda w: F.slice("x", w * step + 1, F.lit(length)))
    return e.select("record", "vec_id", F.posexplode(cut).alias("w", "x")).withColumn("t", (F.col("w") * step + length) / 64.0)


def flagship_onset_alignment(spark, d):  # noqa: ANN001, ANN201
    x = _windows(spark, d, 16, 2).select("record", "vec_id", "t", arrays.log_floor(arrays.line_length(F.col("x"))).alias("v"))
    t = F.col("t")
    z = onset.zscores(x, ["record", "vec_id"], "v", t.between(0.25, 0.5))
    g = onset.align(onset.trajectory(z, "record", "t"), "record", "t", t.between(0.25, 0.5), t.between(0.625, 0.875), t.between(0.625, 1.0))
    return g.select("record", "peak_time", *[r6(c).alias(c) for c in ("baseline_level", "early_level", "early_contrast")])


def window_kernels(spark, d):  # noqa: ANN001, ANN201
    x = _windows(spark, d, 16, 8).withColumn("c", arrays.centred(F.col("x")))
    c = F.col("c")
    return x.select("vec_id", "w", r6(arrays.line_length(c)).alias("line_length"), r6(arrays.rms(c)).alias("rms"), r6(arrays.teager(c)).alias("teager"), r6(arrays.kurtosis(c)).alias("kurtosis"))


def composite_scores(spark, d):  # noqa: ANN001, ANN201
    """Median of three, four and five values, joint score and two-sided score of a row."""
    e = [F.col("embedding")[i].cast("double") for i in range(5)]
    sort = lambda *c: F.sort_array(F.array(*c))
    p = [F.greatest(c, F.lit(0.0)) for c in e]
    return table(spark, d, "embeddings").select(
        "vec_id",
        r6(sort(*e[:3])[1]).alias("median3"),
        r6((sort(*p[:4])[1] + sort(*p[:4])[2]) / 2).alias("median4"),
        r6(sort(*e)[2]).alias("median5"),
        r6(F.sqrt(p[0] * p[1])).alias("joint"),
        r6(F.abs(e[2])).alias("two_sided"),
        r6(F.greatest(e[3] - sort(*e)[2], F.lit(0.0))).alias("lead"),
    )


def dft_band_power(spark, d):  # noqa: ANN001, ANN201
    """Band logs, centroid and entropy of the tapered spectrum, bins 1 to 8 of a 16-point window."""
    x = _windows(spark, d, 16, 16).withColumn("c", arrays.centred(F.col("x")))
    power = arrays.tapered_power(F.col("c"), 16, range(1, 9))
    x = x.withColumns({f"p{k}": v for k, v in power.items()})
    p = {k: F.col(f"p{k}") for k in power}
    whole = sum(p.values(), F.lit(0.0))
    entropy = sum((-(p[k] / whole) * F.log(F.greatest(p[k] / whole, F.lit(arrays.TINY))) for k in p), F.lit(0.0)) / F.log(F.lit(8.0))
    low, high = p[1] + p[2], p[5] + p[6] + p[7] + p[8]
    return x.select(
        "vec_id", "w", r6(arrays.log_floor(low)).alias("low"), r6(arrays.log_floor(high)).alias("high"), r6(arrays.log_floor(high) - arrays.log_floor(low)).alias("high_low"),
        r6(sum((k * p[k] for k in p), F.lit(0.0)) / whole).alias("centroid"), r6(entropy).alias("entropy"), r6(arrays.log_floor(F.greatest(*p.values()) / whole)).alias("rhythmicity"),
    )


def frame_quantile_features(spark, d):  # noqa: ANN001, ANN201
    """Per record: quantiles over all frames, and the frame-wise 0.9 quantile's maximum, deviation and late rise."""
    x = _windows(spark, d, 8, 8).select("record", "vec_id", "w", F.log(F.sqrt(arrays.mean(F.transform("x", lambda v: v * v)) + 1e-8)).alias("v"))
    a = x.groupBy("record").agg(F.expr("percentile(v, array(0.1, 0.5, 0.9, 0.99))").alias("q"))
    frame = x.groupBy("record", "w").agg(F.percentile("v", 0.9).alias("f"), F.median("v").alias("m"))
    late, base = F.col("w") >= 4, F.col("w") < 4
    b = frame.groupBy("record").agg(F.max("f").alias("fm"), F.stddev_pop("f").alias("fs"), (F.median(F.when(late, F.col("m"))) - F.median(F.when(base, F.col("m")))).alias("lb"))
    return a.join(b, "record").select("record", *[r6(F.col("q")[i]).alias(n) for i, n in enumerate(("q10", "q50", "q90", "q99"))], r6("fm").alias("frame_max"), r6("fs").alias("frame_std"), r6("lb").alias("late_minus_base"))


def _last_samples(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "embeddings").select(F.col("label").alias("record"), "vec_id", arrays.doubles(F.slice("embedding", 53, 12)).alias("x"))


def pairwise_correlation_density(spark, d):  # noqa: ANN001, ANN201
    """Share of correlations above 0.3 over the last twelve samples, all channel pairs of each record."""
    return pairs.pair_density(_last_samples(spark, d), 0.3).select("record", "pairs", r6(F.col("over") / F.col("pairs")).alias("density"))


def lagged_outflow(spark, d):  # noqa: ANN001, ANN201
    """Mean of the three largest positive lag-one correlations out of and into each channel, all channels of each record."""
    x = pairs.strongest(_last_samples(spark, d), 1, 3)
    return x.select("record", "vec_id", r6("out").alias("outflow"), r6("into").alias("inflow"), r6(F.col("out") - F.col("into")).alias("net"))


QUERIES = {f.__name__: f for f in (flagship_onset_alignment, window_kernels, composite_scores, dft_band_power, frame_quantile_features, pairwise_correlation_density, lagged_outflow)}


def _window_sql(length: int, step: int) -> str:
    n = (64 - length) // step + 1
    return f"(SELECT label AS record, vec_id, w, (w * {step} + {length}) / 64.0::DOUBLE AS t, CAST(embedding AS DOUBLE[])[w * {step} + 1 : w * {step} + {length}] AS x FROM embeddings, range({n}) r(w))"


COS, SIN = "cos", "sin"


def _spectrum_sql() -> str:
    c = "list_transform(x, lambda v: v - list_sum(x) / 16)"
    tap = "(0.5 - 0.5 * cos(2 * pi() * i / 15))"
    part = lambda k, f: f"list_sum(list_transform(range(16), lambda i: c[i + 1] * {tap} * {f}(2 * pi() * {k} * i / 16)))"
    return f"(SELECT vec_id, w, {', '.join(f'({part(k, COS)}) ** 2 + ({part(k, SIN)}) ** 2 AS p{k}' for k in range(1, 9))} FROM (SELECT *, {c} AS c FROM {_window_sql(16, 16)}))"


_SUM = " + ".join(f"p{k}" for k in range(1, 9))
_LAGGED = """(SELECT a.record, a.vec_id AS src, b.vec_id AS dst, greatest(coalesce(CASE WHEN isnan(corr(a.x, b.x)) THEN 0 ELSE corr(a.x, b.x) END, 0), 0) AS r FROM e a JOIN e b ON a.record = b.record AND a.vec_id <> b.vec_id AND b.i - 1 = a.i GROUP BY 1, 2, 3)"""
_ALL_SAMPLES = "e AS (SELECT label AS record, vec_id, i, CAST(embedding[52 + i] AS DOUBLE) AS x FROM embeddings, range(1, 13) r(i))"

ORACLES = {
    "flagship_onset_alignment": f"""WITH f AS (SELECT record, vec_id, t, ln(greatest(list_sum(list_transform(range(1, 16), lambda i: abs(x[i + 1] - x[i]))) / 15, 1.1754943508222875e-38)) AS v FROM {_window_sql(16, 2)}),
        b AS (SELECT record, vec_id, median(v) AS c, stddev_pop(v) AS s FROM f WHERE t BETWEEN 0.25 AND 0.5 GROUP BY 1, 2),
        m AS (SELECT record, vec_id, 1.4826::DOUBLE * median(abs(v - c)) AS mad FROM f JOIN b USING (record, vec_id) WHERE t BETWEEN 0.25 AND 0.5 GROUP BY 1, 2),
        z AS (SELECT record, t, (v - c) / greatest(CASE WHEN mad > 1e-6 THEN mad ELSE s END, 1e-6) AS z FROM f JOIN b USING (record, vec_id) JOIN m USING (record, vec_id)),
        l AS (SELECT record, t, quantile_cont(z, 0.9) AS q FROM z GROUP BY 1, 2),
        n AS (SELECT *, coalesce(lag(q) OVER w, q) AS a, coalesce(lead(q) OVER w, q) AS d FROM l WINDOW w AS (PARTITION BY record ORDER BY t)),
        k AS (SELECT record, t, a + q + d - greatest(a, q, d) - least(a, q, d) AS y FROM n),
        g AS (SELECT *, y - lag(y) OVER (PARTITION BY record ORDER BY t) AS rise FROM k)
        SELECT record, arg_max(t, {{'r': round(rise, 9), 't': -t}}) FILTER (t BETWEEN 0.625 AND 1.0) AS peak_time, round(median(y) FILTER (t BETWEEN 0.25 AND 0.5), 6) AS baseline_level,
        round(median(y) FILTER (t BETWEEN 0.625 AND 0.875), 6) AS early_level, round(median(y) FILTER (t BETWEEN 0.625 AND 0.875) - median(y) FILTER (t BETWEEN 0.25 AND 0.5), 6) AS early_contrast FROM g GROUP BY record""",
    "window_kernels": f"""SELECT vec_id, w::INT AS w, round(list_sum(list_transform(range(1, 16), lambda i: abs(c[i + 1] - c[i]))) / 15, 6) AS line_length, round(sqrt(list_sum(list_transform(c, lambda v: v * v)) / 16), 6) AS rms,
        round(list_sum(list_transform(range(2, 16), lambda i: abs(c[i] * c[i] - c[i - 1] * c[i + 1]))) / 14, 6) AS teager,
        round(list_sum(list_transform(c, lambda v: v * v * v * v)) / 16 / greatest((list_sum(list_transform(c, lambda v: v * v)) / 16) ** 2, 1.1754943508222875e-38), 6) AS kurtosis
        FROM (SELECT *, list_transform(x, lambda v: v - list_sum(x) / 16) AS c FROM {_window_sql(16, 8)})""",
    "composite_scores": """SELECT vec_id, round(list_sort(e[1:3])[2], 6) AS median3, round((list_sort(p)[2] + list_sort(p)[3]) / 2, 6) AS median4, round(list_sort(e[1:5])[3], 6) AS median5, round(sqrt(p[1] * p[2]), 6) AS joint,
        round(abs(e[3]), 6) AS two_sided, round(greatest(e[4] - list_sort(e[1:5])[3], 0), 6) AS lead
        FROM (SELECT *, list_transform(e[1:4], lambda v: greatest(v, 0)) AS p FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""",
    "dft_band_power": f"""SELECT vec_id, w::INT AS w, round(ln(greatest(p1 + p2, 1.1754943508222875e-38)), 6) AS low, round(ln(greatest(p5 + p6 + p7 + p8, 1.1754943508222875e-38)), 6) AS high,
        round(ln(greatest(p5 + p6 + p7 + p8, 1.1754943508222875e-38)) - ln(greatest(p1 + p2, 1.1754943508222875e-38)), 6) AS high_low,
        round(({' + '.join(f'{k} * p{k}' for k in range(1, 9))}) / s, 6) AS centroid, round(({' + '.join(f'-(p{k} / s) * ln(greatest(p{k} / s, 1.1754943508222875e-38))' for k in range(1, 9))}) / ln(8), 6) AS entropy,
        round(ln(greatest(greatest({', '.join(f'p{k}' for k in range(1, 9))}) / s, 1.1754943508222875e-38)), 6) AS rhythmicity FROM (SELECT *, {_SUM} AS s FROM {_spectrum_sql()})""",
    "frame_quantile_features": f"""WITH f AS (SELECT record, vec_id, w, ln(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 8 + 1e-8)) AS v FROM {_window_sql(8, 8)}),
        a AS (SELECT record, quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.9) AS q90, quantile_cont(v, 0.99) AS q99 FROM f GROUP BY record),
        g AS (SELECT record, w, quantile_cont(v, 0.9) AS f, median(v) AS m FROM f GROUP BY 1, 2),
        b AS (SELECT record, max(f) AS fm, stddev_pop(f) AS fs, median(m) FILTER (w >= 4) - median(m) FILTER (w < 4) AS lb FROM g GROUP BY record)
        SELECT record, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90, round(q99, 6) AS q99, round(fm, 6) AS frame_max, round(fs, 6) AS frame_std, round(lb, 6) AS late_minus_base FROM a JOIN b USING (record)""",
    "pairwise_correlation_density": f"""WITH {_ALL_SAMPLES}, p AS (SELECT a.record, a.vec_id, b.vec_id AS other, corr(a.x, b.x) AS r FROM e a JOIN e b ON a.record = b.record AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY 1, 2, 3)
        SELECT record, count(*) AS pairs, round(avg(CAST(coalesce(r, 0) > 0.3 AS DOUBLE)), 6) AS density FROM p GROUP BY record""",
    "lagged_outflow": f"""WITH {_ALL_SAMPLES}, l AS {_LAGGED},
        o AS (SELECT record, src AS vec_id, avg(r) AS o FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY record, src ORDER BY r DESC) <= 3) GROUP BY 1, 2),
        n AS (SELECT record, dst AS vec_id, avg(r) AS n FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY record, dst ORDER BY r DESC) <= 3) GROUP BY 1, 2)
        SELECT record, vec_id, round(o, 6) AS outflow, round(n, 6) AS inflow, round(o - n, 6) AS net FROM o JOIN n USING (record, vec_id)""",
}
