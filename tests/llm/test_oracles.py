"""The llm queries that have SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from quizloom.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{tiny}/{table}.parquet'")
    found = con.execute(oracles.ORACLES[name])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, tiny)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
