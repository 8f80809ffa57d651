"""Global ranks and exact quantiles against pandas and NumPy, with ties, nulls and keys of every size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry.operators import quantiles, ranks
from wavequarry.plans import lookups


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    parts = {"normal": rng.normal(size=700), "ties": rng.integers(0, 4, 900).astype(float), "wide": np.exp(rng.normal(size=400) * 40), "one": np.array([3.5]), "same": np.full(300, -2.0), "two": np.array([1.0, 1e308, -1e308])}
    rows = [(k, float(v)) for k, x in parts.items() for v in x] + [("normal", None), ("ties", None), ("none", None), (None, 7.0), (None, 9.0), ("wide", float("nan"))]
    return rows


def test_mid_ranks(spark, values, monkeypatch):
    monkeypatch.setattr(ranks, "HOT_ROWS", 20)
    df = spark.createDataFrame(values, "k string, v double").repartition(6).withColumn("other", F.lit(1))
    for keys in ([], ["k"]):
        got = ranks.mid_ranks(df.where("v is null or not isnan(v)"), "v", "r", keys).toPandas()
        assert len(got) == len(values) - 1 and set(got.columns) == {"k", "v", "other", "r"}
        by = got.groupby("k", dropna=False)["v"] if keys else got["v"]
        assert np.allclose(got["r"], by.rank(method="average"), equal_nan=True)
    assert ranks.mid_ranks(df.where("false"), "v", "r").count() == 0


def test_sums_before(spark):
    rows = [(k, v, 10 ** (v % 7), v) for k in "ab" for v in range(120)]
    df = spark.createDataFrame(rows, "k string, v int, n long, m long").repartition(7)
    got = ranks.sums_before(df, "v", ["n", "m"], ["k"]).toPandas().sort_values(["k", "v"])
    want = pd.DataFrame(rows, columns=["k", "v", "n", "m"]).groupby("k")[["n", "m"]].cumsum() - pd.DataFrame(rows, columns=["k", "v", "n", "m"])[["n", "m"]]
    assert (got[["n_before", "m_before"]].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("hot, bins", [(0, 64), (350, 4096), (10**6, 4096)])
def test_quantiles(spark, values, monkeypatch, hot, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    df = spark.createDataFrame(values, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in quantiles.quantiles(df, ["k"], "v", probs, hot).collect()}
    frame = pd.DataFrame(values, columns=["k", "v"]).dropna(subset="v")
    want = {k if isinstance(k, str) else None: np.quantile(g, probs) if k != "two" else [-1e308, -8e307, 1.0, 5.4e307, 1e308] for k, g in frame.groupby("k", dropna=False)["v"]}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-12), k
    spark_own = {r.k: r.q for r in df.where("v is not null and not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    assert got == spark_own


def test_robust_stats(spark, values):
    df = spark.createDataFrame([r for r in values if r[0] not in ("two", "wide")], "k string, v double")
    for hot in (0, 10**6):
        for r in quantiles.robust_stats(df, ["k"], "v", hot).collect():
            x = np.array([v for k, v in values if k == r.k and v is not None])
            mad = np.median(np.abs(x - np.median(x)))
            assert np.allclose([r.center, r.mad, r.spread], [np.median(x), mad, x.std()]) and np.isclose(r.scale, max(1.4826 * mad if 1.4826 * mad > 1e-6 else x.std(), 1e-6))


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert quantiles.quantiles(none, ["k"], "v", [0.5], 0).count() == 0 and quantiles.robust_stats(none, ["k"], "v", 0).count() == 0


def test_rank_composite_does_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Sixty suppliers of the same eight discounts, each in an order of its own: their mean lies on a tie of the fourth decimal."""
    from wavequarry.plans import ordered

    rng = np.random.default_rng(2)
    whole = np.array([1, 2, 3, 5, 7, 9, 10, 6])  # 43 hundredths
    rows = pd.DataFrame({"l_suppkey": np.repeat(np.arange(60), 8), "l_discount": np.concatenate([rng.permutation(whole) / 100 for _ in range(60)]), "l_quantity": 20.0})
    rows["l_shipdate"] = pd.Timestamp("2026-01-01")
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = ordered.rank_composite(spark, str(tmp_path)).toPandas()
    assert len(got) == 60 and (got["rb"] == 30.5).all()


def test_medians_apart_from_distinct_counts(spark, tmp_path):
    rows = [("A", 1, 10.0), ("A", 1, 20.0), ("A", 2, 60000.0), (None, 3, 5.0), (None, None, 7.0), ("R", 4, None), ("N", 5, float("nan")), ("N", 5, 1.0), ("N", 6, 2.0)]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    x = lookups.group_summary_code(spark, str(tmp_path))
    assert {(r.l_returnflag, r.n, r.orders, r.middle) for r in x.collect()} == {("A", 3, 2, 20.0), (None, 2, 1, 6.0), ("R", 1, 1, None), ("N", 3, 2, 2.0)}
    # no aggregate keeps a median's values for each order
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "l_orderkey" in line and "percentile" in line]
