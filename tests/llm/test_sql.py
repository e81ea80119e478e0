"""The training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from glyphsieve.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    rows = queries.QUERIES[name](spark, SF)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(str(tuple(r[n] for n in names)) for r in rows.collect()) == sorted(map(str, found.fetchall()))
