"""Run statistics."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadgeo.functions import st_point
from roadgeo.operators import quantiles, runs
from roadgeo.operators.numbering import numbered


def table(spark, times):
    rows = [(q, i, float(t), f) for q, ts in times.items() for i, (t, f) in enumerate(ts)]
    return spark.createDataFrame(
        rows, "query string, run int, execution_time double, fingerprint string"
    ).repartition(4)


SMALL = {
    "q1": [(3.0, "x"), (1.0, "x"), (2.0, "x")],
    "q2": [(5.0, "x"), (5.0, "y")],
    "q3": [(0.5, None)],
}


def test_timing_and_points(spark):
    numbered_runs = table(spark, SMALL)
    timing = runs.run_timing(numbered_runs)
    assert timing.columns == ["query", "run", "execution_time", "avg_time", "min_time", "max_time"]
    q1 = sorted(tuple(r)[1:] for r in timing.collect() if r["query"] == "q1")
    assert q1 == [(0, 3.0, 2.0, 1.0, 3.0), (1, 1.0, 2.0, 1.0, 3.0), (2, 2.0, 2.0, 1.0, 3.0)]
    points = {(r["query"], r["run"], r["execution_time"]) for r in runs.run_points(numbered_runs).collect()}
    assert points == {(q, i + 1, t) for q, ts in SMALL.items() for i, (t, _) in enumerate(ts)}


def test_a_null_query_is_kept(spark):
    some = spark.createDataFrame([(None, 0, 1.0), (None, 1, 3.0), ("q", 0, 2.0)], "query string, run int, execution_time double")
    assert {(r["query"], r["run"], r["avg_time"]) for r in runs.run_timing(some).collect()} == {(None, 0, 2.0), (None, 1, 2.0), ("q", 0, 2.0)}
    assert {(r["query"], r["median"]) for r in runs.run_box_stats(some).collect()} == {(None, 2.0), ("q", 2.0)}


def test_numbers_have_no_gaps(spark):
    """One group holds most rows and lies in many ranges; a null group is a group."""
    rows = [("hot", i * 7 % 5000) for i in range(5000)] + [("b", 5), ("b", 3), (None, 9), (None, 1)]
    df = spark.createDataFrame(rows, "g string, t int").repartition(5)
    got = numbered(df, "g", ["t"], "n").collect()
    for g in ("hot", "b", None):
        own = sorted((r["n"], r["t"]) for r in got if r["g"] == g)
        assert [n for n, _ in own] == list(range(len(own))) and [t for _, t in own] == sorted(t for _, t in own)


def test_means_ascend(spark):
    got = [tuple(r) for r in runs.run_means(table(spark, SMALL)).collect()]
    assert got == [("q3", 0.5), ("q1", 2.0), ("q2", 5.0)]


def test_agreement(spark):
    got = {r["query"]: r["agree"] for r in runs.run_agreement(table(spark, SMALL)).collect()}
    assert got == {"q1": True, "q2": False, "q3": False}


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    rng = random.Random(accuracy)
    groups = {
        "wide": [rng.gauss(0, 1) for _ in range(3001)],
        "ties": [float(rng.randint(0, 3)) for _ in range(2500)],
        "one": [7.0],
        "two": [1.0, 2.0],
        "hot": [4.0] * 2000 + [rng.random() for _ in range(900)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    p = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, "g", "v", p, accuracy).collect()
    assert {r["g"]: r["n"] for r in got} == {g: len(v) for g, v in groups.items()}
    for r in got:
        assert r["quantiles"] == pytest.approx(np.quantile(groups[r["g"]], p).tolist(), rel=1e-12)


def test_a_wrong_bracket_stops_the_job(spark, monkeypatch):
    """Were a bracket ever wrong, the query fails rather than giving a wrong number."""
    real = F.percentile_approx
    monkeypatch.setattr(
        quantiles.F, "percentile_approx",
        lambda c, p, a: F.transform(real(c, p, a), lambda v: v * 0 - 1),
    )
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(PySparkException, match="outside its bracket"):
        quantiles.exact_quantiles(df, "g", "v", [0.5], 10).collect()


def test_box_stats(spark):
    times = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 50.0, -40.0]
    got = runs.run_box_stats(table(spark, {"q": [(t, "x") for t in times]})).first()
    assert tuple(got) == ("q", 2.0, 4.0, 6.0, 1.0, 7.0, 2)


def test_frame_diff_and_fingerprint(spark):
    a = spark.createDataFrame([(1, {"k": "v"}), (2, {}), (2, {})], "id int, tags map<string,string>")
    a = a.withColumn("g", st_point("id", "id"))
    shifted = a.withColumn("g", st_point(F.col("id") + 1, "id")).repartition(3)
    assert runs.frame_diff(a, shifted).count() == 0  # geometry is left out
    assert runs.fingerprint(a).collect() == runs.fingerprint(shifted).collect()
    fewer = a.dropDuplicates(["id"])
    assert [(r["id"], r["only_in"]) for r in runs.frame_diff(a, fewer).collect()] == [(2, "a")]
    assert [(r["id"], r["only_in"]) for r in runs.frame_diff(fewer, a.unionByName(a)).collect()].count((2, "b")) == 3
    assert runs.fingerprint(a).collect() != runs.fingerprint(fewer).collect()
    assert runs.fingerprint(a.limit(0)).first()["n_rows"] == 0


def test_sweeps(spark):
    df = spark.range(10)
    by_limit = runs.parameter_sweep(
        df, [{"n": 3}, {"n": 7}],
        lambda d: d.filter("id < param.n").groupBy("param.n").count(),
    )
    assert {tuple(r) for r in by_limit.collect()} == {(3, 3), (7, 7)}
    df.createOrReplaceTempView("numbers")
    text = "SELECT count(*) AS c FROM numbers WHERE id < :n"
    got = runs.sql_sweep(spark, text, [{"n": 3}, {"n": 7}]).collect()
    assert {(r["n"], r["c"]) for r in got} == {(3, 3), (7, 7)}


def test_sql_sweep_scans_once(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS kind", "'a:n' AS t").write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("swept")
    text = "SELECT count(*) AS c, max(id)::int AS m FROM swept WHERE kind = :kind AND id < :n AND t = 'a:n'"
    sets = [{"kind": 0, "n": 50}, {"kind": 1, "n": 10}, {"kind": 7, "n": 10}]
    found = runs.sql_sweep(spark, text, sets)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {(r["kind"], r["n"], r["c"], r["m"]) for r in found.collect()} == {(0, 50, 17, 48), (1, 10, 3, 7), (7, 10, 0, None)}


def test_sql_sweep_of_other_texts(spark):
    """A text that Spark does not join laterally."""
    spark.range(100).createOrReplaceTempView("limited")
    text = "SELECT sum(a.id) AS s FROM limited a LEFT JOIN limited b ON a.id = b.id + :n WHERE b.id IS NULL"
    assert {(r["n"], r["s"]) for r in runs.sql_sweep(spark, text, [{"n": 1}, {"n": 3}]).collect()} == {(1, 0), (3, 3)}
