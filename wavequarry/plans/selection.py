"""Quantiles and ranks of groups that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavequarry.operators import quantiles, ranks
from wavequarry.plans.lookups import r6, table

PROBS = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}


def hot_group_quantiles(spark, d):  # noqa: ANN001, ANN201
    """Five exact quantiles of the prices of each return flag, selected by histograms whatever the size."""
    x = quantiles.quantiles(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", list(PROBS.values()), hot=0)
    return x.select("l_returnflag", "l_linestatus", *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(PROBS)])


def hot_group_robust_scale(spark, d):  # noqa: ANN001, ANN201
    """Median, median absolute deviation, deviation and scale of the totals of each order priority, and of quantities full of ties for each ship mode."""
    a = quantiles.robust_stats(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", hot=0).withColumnRenamed("o_orderpriority", "name")
    b = quantiles.robust_stats(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", hot=0).withColumnRenamed("l_linestatus", "name")
    x = a.unionByName(b)
    return x.select("name", *[r6(c).alias(c) for c in ("center", "mad", "spread", "scale")])


def global_mid_rank(spark, d):  # noqa: ANN001, ANN201
    """Average-tie ranks of every line among all lines by quantity, and among those of its flag by price."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    x = ranks.mid_ranks(ranks.mid_ranks(x, "l_quantity", "quantity_rank"), "l_extendedprice", "price_rank", ["l_returnflag"])
    return x.select("l_orderkey", "l_linenumber", "quantity_rank", "price_rank")


def source_length_quantiles(spark, d):  # noqa: ANN001, ANN201
    """Five exact quantiles of the lengths of each source's documents; one source may hold a third of them."""
    x = quantiles.quantiles(table(spark, d, "documents"), ["source"], "n_chars", list(PROBS.values()), hot=0)
    return x.select("source", *[r6(F.col("q")[k]).alias(n) for k, n in enumerate(PROBS)])


def document_mid_rank(spark, d):  # noqa: ANN001, ANN201
    """Average-tie ranks of every document by length, among all and among those of its source."""
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ranks.mid_ranks(ranks.mid_ranks(x, "n_chars", "length_rank"), "n_chars", "source_rank", ["source"]).select("doc_id", "length_rank", "source_rank")


QUERIES = {f.__name__: f for f in (hot_group_quantiles, hot_group_robust_scale, global_mid_rank, source_length_quantiles, document_mid_rank)}


def _stats(keys: str, value: str, of: str) -> str:
    c = f"(SELECT {keys} AS name, median({value}) AS center, stddev_pop({value}) AS spread FROM {of} GROUP BY 1)"
    return f"SELECT name, any_value(center) AS center, median(abs({value} - center)) AS mad, any_value(spread) AS spread FROM {of} JOIN {c} ON {keys} = name GROUP BY name"


ORACLES = {
    "hot_group_quantiles": f"SELECT l_returnflag, l_linestatus, {', '.join(f'round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {p}), 6) AS {n}' for n, p in PROBS.items())} FROM lineitem GROUP BY 1, 2",
    "hot_group_robust_scale": f"""WITH s AS ({_stats('o_orderpriority', 'o_totalprice', 'orders')} UNION ALL {_stats('l_linestatus', 'l_quantity', 'lineitem')})
        SELECT name, round(center, 6) AS center, round(mad, 6) AS mad, round(spread, 6) AS spread, round(greatest(CASE WHEN 1.4826::DOUBLE * mad > 1e-6 THEN 1.4826::DOUBLE * mad ELSE spread END, 1e-6), 6) AS scale FROM s""",
    "global_mid_rank": """SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS quantity_rank,
        rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS price_rank FROM lineitem""",
    "source_length_quantiles": f"SELECT source, {', '.join(f'round(quantile_cont(CAST(n_chars AS DOUBLE), {p}), 6) AS {n}' for n, p in PROBS.items())} FROM documents WHERE n_chars IS NOT NULL GROUP BY 1",
    "document_mid_rank": """SELECT doc_id, CASE WHEN n_chars IS NOT NULL THEN rank() OVER (ORDER BY n_chars NULLS LAST) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE END AS length_rank,
        CASE WHEN n_chars IS NOT NULL THEN rank() OVER (PARTITION BY source ORDER BY n_chars NULLS LAST) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2.0::DOUBLE END AS source_rank FROM documents""",
}
