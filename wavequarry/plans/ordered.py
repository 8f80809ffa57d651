"""Ordered operators: top-k, robust scaling, smoothing, runs, thresholds and ranks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.functions import robust
from wavequarry.operators import ranks
from wavequarry.plans.lookups import r6, share, table
from wavequarry.sources import shared


def _hourly(spark, d):  # noqa: ANN001, ANN202
    """0.9 quantile of the values of each event type and hour; at most one row an hour and type."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return table(spark, d, "events").groupBy("event_type", hour.alias("h")).agg(F.expr("percentile(value, 0.9)").alias("q"))


def _by_hour():  # noqa: ANN202
    return W.partitionBy("event_type").orderBy("h")


_HOURLY_SQL = "(SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h, quantile_cont(value, 0.9) AS q FROM events GROUP BY 1, 2)"


def topk_per_group(spark, d):  # noqa: ANN001, ANN201
    w = W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("hit", F.row_number().over(w)).where("hit <= 10").select("event_type", "hit", "event_id", "value")


def _top_users(spark, d, measure, name):  # noqa: ANN001, ANN202
    g = table(spark, d, "events").groupBy("event_type", "user_id").agg(measure.alias("m"))
    w = W.partitionBy("event_type").orderBy(F.desc("m"), "user_id")
    top = g.withColumn("p", F.row_number().over(w)).where("p <= 10")
    return top.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "user_id"))), lambda s: s["user_id"]).alias(name))


def top10_overlap(spark, d):  # noqa: ANN001, ANN201
    a, b = _top_users(spark, d, F.max("value"), "a"), _top_users(spark, d, F.count("*"), "b")
    return a.join(b, "event_type").select("event_type", F.size(F.array_intersect("a", "b")).cast("long").alias("overlap"))


def rank_aware_score(spark, d):  # noqa: ANN001, ANN201
    truth, predicted = _top_users(spark, d, F.max("value"), "t"), _top_users(spark, d, F.count("*"), "p")
    t = truth.select("event_type", F.posexplode("t").alias("i", "user_id"))
    p = predicted.select("event_type", F.posexplode("p").alias("j", "user_id"))
    log2 = lambda c: F.log2(F.col(c) + 2.0)
    ideal = F.sum(1 / (log2("i") * log2("i")))
    got = p.join(t, ["event_type", "user_id"]).groupBy("event_type").agg(F.sum(1 / (log2("i") * log2("j"))).alias("dcg"))
    return t.groupBy("event_type").agg(ideal.alias("ideal")).join(got, "event_type", "left").select("event_type", r6(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("rank_score"))


_TOP_SQL = """(SELECT * FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY m DESC, user_id) AS p
    FROM (SELECT event_type, user_id, {m} AS m FROM events GROUP BY 1, 2)) WHERE p <= 10)"""


def enrichment(spark, d):  # noqa: ANN001, ANN201
    v = F.col("value")
    inside = F.col("user_id") % 7 == 0
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.median(F.when(inside, v)) - F.median(F.when(~inside, v))).alias("enrichment"))


def interval_levels(spark, d):  # noqa: ANN001, ANN201
    """Baseline and early levels around a per-user onset: the time of the user's largest value."""
    e = table(spark, d, "events").select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    onset = e.groupBy("user_id").agg(F.max_by("t", F.struct("value", -F.col("event_id"))).alias("onset"))
    x = e.join(onset, "user_id").withColumn("rel", F.col("t") - F.col("onset"))
    base, early = F.col("rel").between(-400_000, -20_000), F.col("rel").between(0, 200_000)
    v = F.col("value")
    return x.groupBy("user_id").agg(F.count_if(base).alias("n_base"), r6(F.median(F.when(base, v))).alias("baseline"), r6(F.median(F.when(early, v))).alias("early"), r6(F.median(F.when(early, v)) - F.median(F.when(base, v))).alias("contrast"))


def threshold_fallback_filter(spark, d):  # noqa: ANN001, ANN201
    """Rows under a limit; a group that would keep fewer than ten stays whole."""
    clean = F.coalesce(F.col("value"), F.lit(0.0)) <= 20
    kept = F.count_if(clean).over(W.partitionBy("user_id"))
    return table(spark, d, "events").withColumn("clean", clean).withColumn("k", kept).where("clean or k < 10").select("event_id", "user_id", "value")


def robust_zscore(spark, d):  # noqa: ANN001, ANN201
    """Each user's values on the scale of the user's first twenty events."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    whole = W.partitionBy("user_id")
    inside = F.col("i") <= 20
    x = table(spark, d, "events").withColumn("i", F.row_number().over(order))
    stats = robust.baseline_stats(F.col("value"), inside)
    x = x.withColumns({k: c.over(whole) for k, c in stats.items()})
    x = x.withColumn("mad", F.median(F.when(inside, F.abs(F.col("value") - F.col("center")))).over(whole))
    return x.select("event_id", "user_id", r6((F.col("value") - F.col("center")) / robust.robust_scale(F.col("mad"), F.col("spread"))).alias("z"))


def mad_scale_clip(spark, d):  # noqa: ANN001, ANN201
    whole = W.partitionBy("user_id")
    x = table(spark, d, "events").withColumn("center", F.median("value").over(whole))
    x = x.withColumn("scale", F.greatest(robust.MAD_FACTOR * F.median(F.abs(F.col("value") - F.col("center"))).over(whole), F.lit(robust.LEAST_SCALE)))
    return x.select("event_id", r6(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), (F.col("value") - F.col("center")) / F.col("scale")))).alias("scaled"))


def causal_rolling_mean(spark, d):  # noqa: ANN001, ANN201
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", r6(robust.causal_mean(F.col("value"), w, 8)).alias("mean8"))


def median_filter(spark, d):  # noqa: ANN001, ANN201
    return _hourly(spark, d).select("event_type", "h", r6(robust.median_filter3(F.col("q"), _by_hour())).alias("filtered"))


def moving_mean_same(spark, d):  # noqa: ANN001, ANN201
    return _hourly(spark, d).select("event_type", "h", r6(robust.mean3_padded(F.col("q"), _by_hour())).alias("smoothed"))


def change_rate(spark, d):  # noqa: ANN001, ANN201
    """Causal mean over three of the rises per step; the first rise is zero."""
    x = _hourly(spark, d).withColumn("rise", F.coalesce(F.greatest((F.col("q") - F.lag("q").over(_by_hour())) / 0.125, F.lit(0.0)), F.lit(0.0)))
    return x.select("event_type", "h", r6(robust.causal_mean(F.col("rise"), _by_hour(), 3)).alias("rate"))


def _runs(spark, d):  # noqa: ANN001, ANN202
    x = _hourly(spark, d).withColumn("i", F.row_number().over(_by_hour()) - 1)
    return x.withColumns({"n1": F.lead("q", 1).over(_by_hour()), "n2": F.lead("q", 2).over(_by_hour())})


def first_sustained_run(spark, d):  # noqa: ANN001, ANN201
    """First position from the tenth on where three values in a row reach 100; else the largest value's."""
    run = (F.col("i") >= 10) & (F.col("q") >= 100) & (F.col("n1") >= 100) & (F.col("n2") >= 100)
    fallback = F.max_by(F.when(F.col("i") >= 10, F.col("i")), F.when(F.col("i") >= 10, F.struct("q", -F.col("i"))))
    return _runs(spark, d).groupBy("event_type").agg(F.coalesce(F.min(F.when(run, F.col("i"))), fallback).cast("long").alias("position"))


def threshold_sweep(spark, d):  # noqa: ANN001, ANN201
    """Of 31 thresholds the first that puts the sustained runs closest to position 24 on average."""
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: 40.0 + 4.0 * k)).alias("threshold")
    x = _runs(spark, d).select("event_type", "i", "q", "n1", "n2", steps)
    t = F.col("threshold")
    run = (F.col("i") >= 10) & (F.col("q") >= t) & (F.col("n1") >= t) & (F.col("n2") >= t)
    fallback = F.max_by(F.when(F.col("i") >= 10, F.col("i")), F.when(F.col("i") >= 10, F.struct("q", -F.col("i"))))
    found = x.groupBy("event_type", "threshold").agg(F.coalesce(F.min(F.when(run, F.col("i"))), fallback).alias("p"))
    errors = found.groupBy("threshold").agg(F.avg(F.abs(F.col("p") - 24).cast("double")).alias("mae"))
    return errors.agg(F.min_by("threshold", F.struct("mae", "threshold")).alias("threshold"), r6(F.min("mae")).alias("mae"))


def _mean_4(c):  # noqa: ANN001, ANN202
    """Mean to four decimals from an exact sum, so that no order of rows and tasks changes it; half a last place goes down.

    A floating sum comes out on either side of such a tie as its rows are dealt; added in the table's order it falls short of it.
    """
    v = F.col(c)
    plain = F.abs(v) < 1e9  # false for NaN, infinity and what a decimal of ten places cannot hold
    total = F.sum(F.expr(f"CASE WHEN abs({c}) < 1e9 THEN CAST({c} AS DECIMAL(20, 10)) END"))
    exact = (F.ceil(total * 10000 / F.count(c) - F.expr("0.5BD")).cast("double")) / 10000
    return F.when(F.coalesce(F.bool_and(plain), F.lit(True)), exact).otherwise(F.round(F.avg(c), 4))


def rank_composite(spark, d):  # noqa: ANN001, ANN201
    """Average-tie ranks of three measures and their mean over those that are there."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.median(F.abs(F.col("l_quantity") - 25.0)).alias("a"),
        _mean_4("l_discount").alias("b"),
        F.nullif(F.countDistinct("l_shipdate") % 5, F.lit(0)).cast("double").alias("c"),
    )
    x = shared.stored(m, shared.folder(spark), "measures")
    for c in "abc":
        x = ranks.mid_ranks(x, c, f"r{c}")
    return x.select("l_suppkey", "ra", "rb", "rc", r6(robust.mean_present(F.col("ra"), F.col("rb"), F.col("rc"))).alias("score"))


def run_length_median(spark, d):  # noqa: ANN001, ANN201
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    change = F.coalesce((F.col("event_type") != F.lag("event_type").over(order)).cast("int"), F.lit(0))
    x = table(spark, d, "events").withColumn("change", change)
    x = x.withColumn("run", F.sum("change").over(order))
    runs = x.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.sum("change").alias("changes"))
    return runs.groupBy("user_id").agg(r6(F.median("n")).alias("median_run"), r6(F.sum("changes") / (F.sum("n") - 1).cast("double")).alias("transition_rate"))


def complete_bin_trajectory(spark, d):  # noqa: ANN001, ANN201
    """Quartiles per time bin, only of bins in which every event type is present."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    b = F.rint(hours / 4) * 4
    x = table(spark, d, "events").withColumn("bin", b)
    n_types = F.broadcast(x.agg(F.countDistinct("event_type").alias("n_types")))  # one row
    q = F.expr("percentile(value, array(0.25, 0.5, 0.75))")
    return x.groupBy("bin").agg(q.alias("q"), F.countDistinct("event_type").alias("records"), F.count("*").alias("n")).join(n_types, F.col("records") == F.col("n_types")).select(F.col("bin").cast("long").alias("bin"), r6(F.col("q")[0]).alias("q25"), r6(F.col("q")[1]).alias("q50"), r6(F.col("q")[2]).alias("q75"), "n")


def recruited_fraction(spark, d):  # noqa: ANN001, ANN201
    """Per hour: share of values beyond two and three scales, spread between quantiles, and the front between them."""
    whole = W.partitionBy("user_id")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    x = table(spark, d, "events").withColumn("z", (F.col("value") - F.avg("value").over(whole)) / F.stddev_pop("value").over(whole))
    g = x.groupBy(hour.alias("h")).agg(F.avg((F.col("z") > 1).cast("double")).alias("f1"), F.avg((F.col("z") > 2).cast("double")).alias("f2"), F.expr("percentile(z, 0.9) - percentile(z, 0.5)").alias("spread"))
    return g.select("h", r6("f1").alias("fraction1"), r6("f2").alias("fraction2"), r6("spread").alias("dispersion"), r6(F.col("f1") * (1 - F.col("f1"))).alias("front"))


def hopping_windows(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "2 hours", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "total")


def session_windows(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def binary_metrics(spark, d):  # noqa: ANN001, ANN201
    """AUC by average ranks, F1, sensitivity and specificity of a length score against the quality labels."""
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("s"))
    g = x.groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    ranked = ranks.sums_before(g, "s", ["n"]).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2)
    t = ranked.agg(
        F.sum(F.col("p") * F.col("rank")).cast("double").alias("r"), F.sum("p").cast("double").alias("n1"), F.sum(F.col("n") - F.col("p")).cast("double").alias("n0"),
        F.sum(F.when(F.col("s") >= 800, F.col("p")).otherwise(0)).cast("double").alias("tp"), F.sum(F.when(F.col("s") >= 800, F.col("n") - F.col("p")).otherwise(0)).cast("double").alias("fp"),
    )
    return t.select(
        r6((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"),
        r6(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n1"))).alias("f1"),
        r6(F.col("tp") / F.col("n1")).alias("sensitivity"),
        r6(1 - F.col("fp") / F.col("n0")).alias("specificity"),
    )


QUERIES = {f.__name__: f for f in (
    topk_per_group, top10_overlap, rank_aware_score, enrichment, interval_levels, threshold_fallback_filter, robust_zscore, mad_scale_clip, causal_rolling_mean,
    median_filter, moving_mean_same, change_rate, first_sustained_run, threshold_sweep, rank_composite, run_length_median, complete_bin_trajectory,
    recruited_fraction, hopping_windows, session_windows, binary_metrics,
)}

ORACLES = {
    "topk_per_group": "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS hit, event_id, value FROM events QUALIFY hit <= 10",
    "top10_overlap": f"SELECT a.event_type, count(b.user_id) AS overlap FROM {_TOP_SQL.format(m='max(value)')} a LEFT JOIN {_TOP_SQL.format(m='count(*)')} b ON a.event_type = b.event_type AND a.user_id = b.user_id GROUP BY a.event_type",
    "rank_aware_score": f"""SELECT t.event_type, round(coalesce(sum(CASE WHEN p.p IS NOT NULL THEN 1 / (log2(t.p + 1.0::DOUBLE) * log2(p.p + 1.0::DOUBLE)) END), 0) / sum(1 / (log2(t.p + 1.0::DOUBLE) * log2(t.p + 1.0::DOUBLE))), 6) AS rank_score
        FROM {_TOP_SQL.format(m='max(value)')} t LEFT JOIN {_TOP_SQL.format(m='count(*)')} p ON t.event_type = p.event_type AND t.user_id = p.user_id GROUP BY t.event_type""",
    "enrichment": "SELECT event_type, round(median(value) FILTER (user_id % 7 = 0) - median(value) FILTER (user_id % 7 <> 0), 6) AS enrichment FROM events GROUP BY event_type",
    "interval_levels": """WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
        o AS (SELECT user_id, t AS onset FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1),
        x AS (SELECT e.*, t - onset AS rel FROM e JOIN o USING (user_id))
        SELECT user_id, count(*) FILTER (rel BETWEEN -400000 AND -20000) AS n_base, round(median(value) FILTER (rel BETWEEN -400000 AND -20000), 6) AS baseline,
        round(median(value) FILTER (rel BETWEEN 0 AND 200000), 6) AS early, round(median(value) FILTER (rel BETWEEN 0 AND 200000) - median(value) FILTER (rel BETWEEN -400000 AND -20000), 6) AS contrast FROM x GROUP BY user_id""",
    "threshold_fallback_filter": "SELECT event_id, user_id, value FROM events QUALIFY coalesce(value, 0) <= 20 OR count(*) FILTER (coalesce(value, 0) <= 20) OVER (PARTITION BY user_id) < 10",
    "robust_zscore": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        b AS (SELECT user_id, median(value) AS c, stddev_pop(value) AS s FROM x WHERE i <= 20 GROUP BY user_id),
        m AS (SELECT user_id, median(abs(value - c)) AS mad FROM x JOIN b USING (user_id) WHERE i <= 20 GROUP BY user_id)
        SELECT event_id, user_id, round((value - c) / greatest(CASE WHEN 1.4826::DOUBLE * mad > 1e-6 THEN 1.4826::DOUBLE * mad ELSE s END, 1e-6), 6) AS z FROM x JOIN b USING (user_id) JOIN m USING (user_id)""",
    "mad_scale_clip": """WITH c AS (SELECT user_id, median(value) AS c FROM events GROUP BY user_id), m AS (SELECT user_id, greatest(1.4826::DOUBLE * median(abs(value - c)), 1e-6) AS s FROM events JOIN c USING (user_id) GROUP BY user_id)
        SELECT event_id, round(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, (value - c) / s)), 6) AS scaled FROM events JOIN c USING (user_id) JOIN m USING (user_id)""",
    "causal_rolling_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS mean8 FROM events",
    "median_filter": f"""SELECT event_type, h, round(a + q + b - greatest(a, q, b) - least(a, q, b), 6) AS filtered FROM (SELECT *, coalesce(lag(q) OVER w, q) AS a, coalesce(lead(q) OVER w, q) AS b FROM {_HOURLY_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY h))""",
    "moving_mean_same": f"SELECT event_type, h, round((coalesce(lag(q) OVER w, 0) + q + coalesce(lead(q) OVER w, 0)) / 3, 6) AS smoothed FROM {_HOURLY_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY h)",
    "change_rate": f"""SELECT event_type, h, round(avg(rise) OVER (PARTITION BY event_type ORDER BY h ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS rate
        FROM (SELECT *, coalesce(greatest((q - lag(q) OVER (PARTITION BY event_type ORDER BY h)) / 0.125::DOUBLE, 0), 0) AS rise FROM {_HOURLY_SQL})""",
    "first_sustained_run": f"""WITH x AS (SELECT *, row_number() OVER w - 1 AS i, lead(q, 1) OVER w AS n1, lead(q, 2) OVER w AS n2 FROM {_HOURLY_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY h))
        SELECT event_type, coalesce(min(i) FILTER (i >= 10 AND q >= 100 AND n1 >= 100 AND n2 >= 100), arg_max(i, {{'q': q, 'i': -i}}) FILTER (i >= 10)) AS position FROM x GROUP BY event_type""",
    "threshold_sweep": f"""WITH x AS (SELECT *, row_number() OVER w - 1 AS i, lead(q, 1) OVER w AS n1, lead(q, 2) OVER w AS n2 FROM {_HOURLY_SQL} WINDOW w AS (PARTITION BY event_type ORDER BY h)),
        f AS (SELECT event_type, t, coalesce(min(i) FILTER (i >= 10 AND q >= t AND n1 >= t AND n2 >= t), arg_max(i, {{'q': q, 'i': -i}}) FILTER (i >= 10)) AS p FROM x, (SELECT 40.0::DOUBLE + 4.0::DOUBLE * k AS t FROM range(31) r(k)) GROUP BY 1, 2),
        e AS (SELECT t, avg(CAST(abs(p - 24) AS DOUBLE)) AS mae FROM f GROUP BY t)
        SELECT t AS threshold, round(mae, 6) AS mae FROM e ORDER BY e.mae, t LIMIT 1""",
    "rank_composite": """WITH m AS (SELECT l_suppkey, median(abs(l_quantity - 25.0::DOUBLE)) AS a, round(avg(l_discount), 4) AS b, CAST(nullif(count(DISTINCT l_shipdate) % 5, 0) AS DOUBLE) AS c FROM lineitem GROUP BY l_suppkey),
        r AS (SELECT l_suppkey, rank() OVER (ORDER BY a) + (count(a) OVER (PARTITION BY a) - 1) / 2::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(b) OVER (PARTITION BY b) - 1) / 2::DOUBLE AS rb,
        CASE WHEN c IS NOT NULL THEN rank() OVER (ORDER BY c NULLS LAST) + (count(c) OVER (PARTITION BY c) - 1) / 2::DOUBLE END AS rc FROM m)
        SELECT *, round((ra + rb + coalesce(rc, 0)) / (2 + CAST(rc IS NOT NULL AS INT)), 6) AS score FROM r""",
    "run_length_median": """WITH x AS (SELECT *, coalesce(CAST(event_type <> lag(event_type) OVER w AS INT), 0) AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        y AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM x), r AS (SELECT user_id, run, count(*) AS n, sum(ch) AS ch FROM y GROUP BY 1, 2)
        SELECT user_id, round(median(n), 6) AS median_run, round(CAST(sum(ch) AS DOUBLE) / CAST(sum(n) - 1 AS DOUBLE), 6) AS transition_rate FROM r GROUP BY user_id""",
    "complete_bin_trajectory": """SELECT CAST(bin AS BIGINT) AS bin, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, count(*) AS n
        FROM (SELECT *, round_even(epoch_us(ts) / 3.6e9::DOUBLE / 4, 0) * 4 AS bin FROM events) GROUP BY bin HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""",
    "recruited_fraction": """WITH z AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id)),
        g AS (SELECT h, avg(CAST(z > 1 AS DOUBLE)) AS f1, avg(CAST(z > 2 AS DOUBLE)) AS f2, quantile_cont(z, 0.9) - quantile_cont(z, 0.5) AS s FROM z GROUP BY h)
        SELECT h, round(f1, 6) AS fraction1, round(f2, 6) AS fraction2, round(s, 6) AS dispersion, round(f1 * (1 - f1), 6) AS front FROM g""",
    "hopping_windows": """SELECT s AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, unnest([b - 1800 * k for k in range(4)]) AS s
        FROM (SELECT *, CAST(floor(epoch_us(ts) / 1800000000) AS BIGINT) * 1800 AS b FROM events)) GROUP BY 1, 2""",
    "session_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "binary_metrics": """WITH x AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2::DOUBLE AS k FROM x),
        t AS (SELECT sum(k) FILTER (y = 1) AS r, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (y = 1 AND s >= 800) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND s >= 800) AS DOUBLE) AS fp FROM r)
        SELECT round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc, round(2 * tp / (tp + fp + n1), 6) AS f1, round(tp / n1, 6) AS sensitivity, round(1 - fp / n0, 6) AS specificity FROM t""",
}
