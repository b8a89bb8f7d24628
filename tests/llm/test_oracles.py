"""Queries that SQL can express, against their DuckDB statements."""

import duckdb
import pytest

from roadgeo.llm import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.ORACLE)
def test_oracle(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
