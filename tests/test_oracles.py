"""Every query of the catalogue that SQL can express against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from wavequarry import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v + 0.0, 5) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr), [names[k] for k in order]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got, got_names = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want, want_names = canonical(cursor.fetchall(), names)
    assert got_names == want_names
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and abs(a - b) <= 2e-6 * max(1, abs(b)), (g, w)
