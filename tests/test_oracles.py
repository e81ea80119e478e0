"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest
from helpers import SF, same_rows

from glyphsieve.plans import oracles, queries


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in oracles.SQL:
        out = tables.execute(oracles.SQL[name])
        assert same_rows(rows, df.columns, [d[0] for d in out.description], out.fetchall())
