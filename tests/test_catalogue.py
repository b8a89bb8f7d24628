"""Every query of the catalogue against its DuckDB statement."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadgeo.plans.catalogue import QUERIES, _stored_names
from tools import compare


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    problem, _, _ = compare.compare(spark, duck, name, sf_dir)
    assert problem is None


@pytest.mark.parametrize("name", ["distance_join_all", "distance_join_close", "q15_self_join_nearby"])
def test_joins_read_stored_ways(spark, sf_dir, name):
    """Each side is read more than once: the assembly is not part of the join's plan."""
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "l_orderkey" not in text and "xmin" in text


def test_nearby_pairs_by_sql_text_read_stored_ways(spark, sf_dir):
    """Stored with the name alone of their tags, and without shuffle files of the assembly left behind."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    text = QUERIES["sql_q15_self_join_nearby"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "l_orderkey" not in text and "FileScan parquet" in text
    assert spark.conf.get(cleanup) == before
    assert set(_stored_names(spark, sf_dir).select(F.explode("tags").alias("k", "v")).distinct().select("k").toPandas()["k"]) == {"name"}


def test_stored_ways_leave_nothing_else(spark, sf_dir, tmp_path, monkeypatch):
    """What is stored on the way to them is removed."""
    monkeypatch.setattr("roadgeo.plans.catalogue.scratch_path", lambda _, name: str(tmp_path / name))
    assert _stored_names(spark, sf_dir).count() > 0
    assert {p.parent.name for p in tmp_path.rglob("*.parquet") if p.is_file()} == {"ways"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "highway_type" and df.count() == 4
