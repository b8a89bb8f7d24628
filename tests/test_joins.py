"""The distance join and the window filter against brute force."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadgeo.functions import st_distance, st_geomfromwkt, st_intersects
from roadgeo.functions import line_from_vertices
from roadgeo.operators.distance_join import _crowded, _in_tiles, _pieced, _split_table, distance_join, first_pairs
from roadgeo.operators.range_filter import range_filter
from roadgeo.operators.tile_join import whole_tiles
from roadgeo.plans import road_queries as Q
from roadgeo.plans.road_sql import register_roads
from roadgeo.sources import tables


def random_shapes(n, seed, crowd=0.0):
    """Short, long, bent and upright lines, and points; a share of them in one spot."""
    rng = random.Random(seed)
    for i in range(n):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        if rng.random() < crowd:
            x, y = 0.3 + rng.uniform(0, 0.001), 0.3 + rng.uniform(0, 0.001)
        kind = rng.random()
        if kind < 0.1:
            yield i, f"POINT({x} {y})"
            continue
        reach = 1.5 if kind < 0.2 else 0.03
        steps = [(rng.uniform(-reach, reach), rng.uniform(-reach, reach)) for _ in range(rng.randint(1, 6))]
        if kind > 0.95:
            steps = [(0.0, dy) for _, dy in steps]
        path = [(x, y)]
        for dx, dy in steps:
            path.append((path[-1][0] + dx, path[-1][1] + dy))
        yield i, "LINESTRING(" + ",".join(f"{a} {b}" for a, b in path) + ")"


def shapes(spark, n, seed, crowd=0.0):
    rows = spark.createDataFrame(list(random_shapes(n, seed, crowd)), "id bigint, t string")
    return rows.select("id", st_geomfromwkt(F.col("t")).alias("geometry")).cache()


def brute(a, b, d, once):
    pairs = a.toDF("a_id", "ga").join(b.toDF("b_id", "gb"), F.lit(True) if not once else F.col("a_id") < F.col("b_id"))
    near = pairs.withColumn("distance", st_distance("ga", "gb")).filter(F.col("distance") < d)
    return near.select("a_id", "b_id", "distance")


def as_set(df):
    rows = [(r["a_id"], r["b_id"], r["distance"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return {(a, b): pytest.approx(d, rel=1e-9, abs=1e-15) for a, b, d in rows}


@pytest.mark.parametrize("d,cell,hot_rows", [(0.02, None, None), (0.02, None, 3), (0.1, 0.05, 10), (0.005, 0.3, None)])
def test_self_join(spark, d, cell, hot_rows):
    a = shapes(spark, 150, seed=1, crowd=0.3)
    got = distance_join(a, a, d, once=True, cell=cell, hot_rows=hot_rows)
    assert got.columns == ["a_id", "b_id", "distance"]
    assert as_set(got) == as_set(brute(a, a, d, once=True))


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_two_sides(spark, hot_rows):
    a, b = shapes(spark, 100, 2, crowd=0.4), shapes(spark, 90, 3, crowd=0.4)
    got = distance_join(a, b, 0.03, hot_rows=hot_rows)
    assert as_set(got) == as_set(brute(a, b, 0.03, once=False))


def test_stored_box_gives_the_same_pairs(spark, tmp_path):
    a = shapes(spark, 120, 4).withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))
    tables.write_geometry_parquet(a, str(tmp_path / "a"), cluster_cell=0.1)
    stored = tables.read_geometry_parquet(spark, str(tmp_path / "a")).drop("n_points", "tags")
    got = distance_join(stored, stored, 0.05, once=True)
    assert as_set(got) == as_set(distance_join(a.drop("tags"), a.drop("tags"), 0.05, once=True))


def test_touching_and_exact_distance(spark):
    rows = ["LINESTRING(0 0,1 0)", "LINESTRING(1 0,2 0)", "LINESTRING(0 0.5,1 0.5)", "POINT(0 -0.25)"]
    a = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select(
        "id", st_geomfromwkt(F.col("t")).alias("geometry")
    )
    got = as_set(distance_join(a, a, 0.5, once=True))
    assert got == {(0, 1): 0.0, (0, 3): 0.25}  # a distance of exactly 0.5 is not below 0.5


def test_a_crowded_cell_is_split_both_ways(spark):
    a = shapes(spark, 400, 5, crowd=0.5)
    hot = _crowded(a, "geometry", 0.04, 0.08, 0.02, 20)
    table = _split_table(hot, hot).collect()
    worst = max(table, key=lambda r: r["a_splits"])
    assert worst["a_splits"] >= 8 and worst["b_splits"] == worst["a_splits"]
    assert len(table) < 40  # quiet cells are not in it


def test_bad_distance(spark):
    a = shapes(spark, 2, 1)
    for d in (0, -1, float("nan")):
        with pytest.raises(ValueError):
            distance_join(a, a, d)


def test_nearest_pairs_are_the_first_of_the_whole_join(spark):
    roads = shapes(spark, 150, 6, crowd=0.3).withColumn(
        "tags", F.create_map(F.lit("name"), F.concat(F.lit("r"), F.col("id")))
    )
    full = Q.nearby_roads(roads, 0.02).orderBy("road1_id", "road2_id").limit(100).collect()
    assert len(full) == 100
    assert Q.self_join_nearby(roads, 0.02).collect() == full


def test_planning_the_nearest_pairs_starts_no_job(spark):
    roads = shapes(spark, 20, 6).withColumn("tags", F.create_map(F.lit("name"), F.lit("r")))
    spark.sparkContext.setJobGroup("planning", "")
    Q.self_join_nearby(roads, 0.02)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0


def test_long_lines_count_as_crowd(spark):
    """Many long lines through one spot: their pieces are counted, and every crowded cell is split."""
    lines = spark.range(300).select(
        "id",
        F.array(*[F.struct(F.lit(float(x)).alias("x"), (F.col("id") * 1e-6 * abs(x)).alias("y")) for x in (-1, 0, 1)]).alias("v"),
    )
    lines = lines.select("id", line_from_vertices("v").alias("geometry"))
    hot = _crowded(lines, "geometry", 0.04, 0.08, 0.02, 50)
    table = _split_table(hot, hot).collect()
    assert len(table) >= 40  # all along the lines, and none is left out
    assert max(r["a_splits"] for r in table) >= 300 // 50


WINDOWS = [
    "POLYGON((-0.2 -0.1,0.3 -0.1,0.3 0.4,-0.2 0.4,-0.2 -0.1))",
    "POLYGON((0 0,0.5 0.1,0.2 0.6,0 0))",
    "POLYGON((-0.5 -0.5,0.5 -0.5,0.5 0.5,-0.5 0.5,-0.5 -0.5),(-0.4 -0.4,0.4 -0.4,0.4 0.4,-0.4 0.4,-0.4 -0.4))",
    "LINESTRING(-1 -1,1 1)",
    "POINT(0.3 0.3)",
    "POLYGON EMPTY",
]


@pytest.mark.parametrize("window", WINDOWS)
def test_range_filter(spark, tmp_path, window):
    a = shapes(spark, 200, 7)
    exact = a.filter(st_intersects("geometry", st_geomfromwkt(window).alias("w")))
    want = {r["id"] for r in exact.collect()}
    assert {r["id"] for r in range_filter(a, window).collect()} == want
    tables.write_geometry_parquet(a.withColumn("tags", F.create_map(F.lit("a"), F.lit("b"))), str(tmp_path / "a"))
    stored = tables.read_geometry_parquet(spark, str(tmp_path / "a"))
    assert {r["id"] for r in range_filter(stored, window).collect()} == want


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_first_pairs_are_those_of_the_join(spark, n):
    """Long lines among short ones, whose pieces meet a row several times."""
    rows = [(i, [(i % 7 * 0.01, i * 0.003), (i % 7 * 0.01 + (0.9 if i % 9 == 0 else 0.004), i * 0.003 + 0.002)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, v array<struct<x:double,y:double>>").select("id", line_from_vertices("v").alias("geometry"))
    whole = sorted((r["a_id"], r["b_id"], r["distance"]) for r in distance_join(df, df, 0.01, once=True).collect())
    found = [(r["a_id"], r["b_id"], r["distance"]) for r in first_pairs(df, df, 0.01, n, once=True).collect()]
    assert len(whole) > 50 and found == whole[:n]


@pytest.mark.parametrize("d", [0.02, 0.3])
def test_pairs_of_sql_text(spark, d):
    """All pairs, and one distance computed for those whose boxes are near alone."""
    a = shapes(spark, 120, seed=6, crowd=0.2).withColumn("tags", F.create_map(F.lit("name"), F.lit("x")))
    register_roads(spark, a)
    got = spark.sql(f"SELECT id AS a_id, other_id AS b_id, distance FROM near_pairs({d}D)")
    assert as_set(got) == as_set(brute(a.select("id", "geometry"), a.select("id", "geometry"), d, once=True))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert len(re.findall(r"c#\d+\.(?:xmax|ymax)\) <=", text)) == 4


def test_a_row_seldom_travels_twice(spark):
    """Before, a short road was sent nearly six times, once for each of the cells that it or its surroundings meet."""
    rng = random.Random(9)
    rows = [(i, f"LINESTRING({x} {y},{x + 0.003} {y + 0.003})") for i in range(2000) for x, y in [(rng.uniform(-1, 1), rng.uniform(-1, 1))]]
    roads = spark.createDataFrame(rows, "id bigint, t string").select("id", st_geomfromwkt(F.col("t")).alias("geometry"))
    placed = _in_tiles(_pieced(roads, "id", "geometry", 0.04), 0.02, 0.005)
    assert 2000 < placed.count() < 2 * 1.3 * 2000


@pytest.mark.parametrize("hot_rows", [None, 5, 20_000])
def test_rows_with_one_key_count_as_one(spark, hot_rows):
    """The least distance of all rows with that key, near each other or not, long or short; a null key is no key of a self join."""
    rows = [(1, "LINESTRING(0 0,0.001 0)"), (1, "LINESTRING(0 0,0.001 0)"), (1, "LINESTRING(0.9 0,0.9 0.001)"), (1, "LINESTRING(0 0.5,3 0.5)"),
            (2, "POINT(0 0.004)"), (2, "POINT(0.9 -0.002)"), (3, "POINT(2.5 0.503)"), (3, "POINT(1 0.507)"), (4, "POINT(0.9 0.008)"),
            (None, "POINT(0 0)"), (None, "POINT(0 0)")]
    a = spark.createDataFrame(rows, "id bigint, t string").select("id", st_geomfromwkt(F.col("t")).alias("geometry"))
    want = {(1, 2): 0.002, (1, 3): 0.003, (1, 4): 0.007}
    assert as_set(distance_join(a, a, 0.01, once=True, hot_rows=hot_rows)) == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    first = first_pairs(a, a, 0.01, 2, once=True, hot_rows=hot_rows).collect()
    assert [(r["a_id"], r["b_id"], pytest.approx(r["distance"], rel=1e-9)) for r in first] == [(1, 2, 0.002), (1, 3, 0.003)]
    both = as_set(distance_join(a, a.select("*"), 0.01, hot_rows=hot_rows))
    assert {k: both[k] for k in want} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    assert both[None, None] == 0 and both[1, None] == 0 and both[2, 1] == pytest.approx(0.002, rel=1e-9)


@pytest.mark.parametrize("kind", ["string", "decimal(9,2)", "date", "double"])
def test_keys_of_other_types(spark, kind):
    a = shapes(spark, 80, 11, crowd=0.3)
    cast = {"date": "date_add(date'2020-01-01', cast(id as int))"}.get(kind, f"cast(id as {kind})")
    b = a.selectExpr(f"{cast} as id", "geometry")
    whole = {tuple(sorted(p)) for p in as_set(distance_join(a, a, 0.03, once=True))}
    back = {r["k"]: r["id"] for r in a.selectExpr("id", f"{cast} as k").collect()}
    got = distance_join(b, b, 0.03, once=True)
    assert got.filter("a_id >= b_id").count() == 0
    assert {tuple(sorted((back[r["a_id"]], back[r["b_id"]]))) for r in got.collect()} == whole


def test_whole_tiles():
    """Chunks end where a tile ends, whatever the batches."""
    tx = [0] * 3 + [1] * 10 + [2] + [3] * 2 + [4] * 30
    table = pa.table({"tx": tx, "ty": [x // 3 for x in tx]})
    for size in (1, 4, 7, 100):
        found = [t["tx"].to_pylist() for t in whole_tiles(iter(table.to_batches(max_chunksize=size)), at_least=5)]
        assert sum(found, []) == tx
        assert all(not set(p) & set(q) for p, q in zip(found, found[1:]))


def test_both_sides_of_near_pairs_read_one_exchange(spark, tmp_path):
    a = shapes(spark, 120, seed=6, crowd=0.2).withColumn("tags", F.create_map(F.lit("name"), F.lit("x")))
    tables.write_geometry_parquet(a, str(tmp_path / "a"))
    register_roads(spark, tables.read_geometry_parquet(spark, str(tmp_path / "a")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.sql("SELECT id AS a_id, other_id AS b_id, distance FROM near_pairs(0.05D)")
        got = as_set(pairs)
        final = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == as_set(brute(a.select("id", "geometry"), a.select("id", "geometry"), 0.05, once=True))
    assert final.count("ReusedExchange") == 1
