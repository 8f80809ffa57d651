"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from wavequarry.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(want.columns) == columns
    rows = lambda r: sorted(map(tuple, r), key=repr)
    assert rows(got.select(*columns).collect()) == rows(con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall())
