"""Channel pairs of whole tables by brute force, in one block and in several."""

import numpy as np
import pandas as pd
import pytest

from wavequarry import catalogue
from wavequarry.operators import pairs

DATA = "/root/testdata/sf0.001"


def correlation(a, b):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    x, y = np.array(both, float).reshape(-1, 2).T
    return float(np.corrcoef(x, y)[0, 1]) if len(both) > 1 and x.min() < x.max() and y.min() < y.max() else 0.0


def brute(channels, lag):
    """(record, src, dst) to correlation."""
    return {(r, i, j): correlation(a, b[lag:]) for r, i, a in channels for s, j, b in channels if r == s and i != j and min(len(a), len(b) - lag) > 0}


@pytest.mark.parametrize("block", [512, 4])
def test_all_pairs_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    random = np.random.default_rng(5)
    channels = [(k % 3, 50 + k, [float(v) for v in np.cumsum(random.normal(size=12))]) for k in range(39)]
    channels += [(0, 900, [2.1] * 12), (1, 901, [None, 1.0] + [float(v) for v in random.normal(size=10)]), (2, 902, [1.0, 3.0, 2.0]), (2, 903, [])]
    df = spark.createDataFrame(channels, "record int, vec_id long, x array<double>")
    want = brute(channels, 0)
    for row in pairs.pair_density(df, 0.3).collect():
        own = [v for (r, i, j), v in want.items() if r == row.record and i < j]
        assert (row.pairs, row.over) == (len(own), sum(v > 0.3 for v in own))
    want, got = brute(channels, 1), {(x.record, x.vec_id): x for x in pairs.strongest(df, 1, 3).collect()}
    assert set(got) == {(r, i) for r, i, a in channels if len(a) > 1}
    for (record, i), row in got.items():
        for side, value in ((1, row.out), (2, row["into"])):
            top = sorted((max(v, 0) for k, v in want.items() if k[0] == record and k[side] == i), reverse=True)[:3]
            assert abs(value - np.mean(top)) < 1e-9


def test_queries_take_whole_tables(spark):
    channels, suppliers = pd.read_parquet(f"{DATA}/embeddings.parquet"), pd.read_parquet(f"{DATA}/supplier.parquet")
    sizes = channels.groupby("label").size()
    got = {r.record: r.pairs for r in catalogue.QUERIES["pairwise_correlation_density"](spark, DATA).collect()}
    assert got == {k: n * (n - 1) // 2 for k, n in sizes.items() if n > 1}
    got = {r.vec_id for r in catalogue.QUERIES["lagged_outflow"](spark, DATA).collect()}
    assert got == set(channels.vec_id[channels.label.map(sizes) > 1])
    assert catalogue.QUERIES["split_column_whole"](spark, DATA).count() == len(suppliers)
