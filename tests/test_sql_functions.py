"""The functions of SQL text against the column functions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadgeo import functions as G
from roadgeo.functions.sql import register_functions

SHAPES = [
    "POINT (3 4)", "POINT EMPTY", "LINESTRING (0 0, 3 4, 3 10)", "LINESTRING (1 1, 1 1)", "LINESTRING (2 5, 9 5)", "LINESTRING EMPTY",
    "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))", "POLYGON ((0 0, 2 0, 4 0, 0 0))", "POLYGON EMPTY",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5)))", None,
]
UNARY = ["st_length", "st_numpoints", "st_area", "st_envelope", "st_centroid", "st_startpoint", "st_endpoint", "st_x", "st_y", "st_astext", "st_aswkb"]


@pytest.fixture(scope="module")
def shapes(spark):
    register_functions(spark)
    df = spark.createDataFrame(list(enumerate(SHAPES)), "id int, t string").select("id", G.st_geomfromwkt(F.col("t")).alias("geometry"))
    df.createOrReplaceTempView("shapes")
    return df


@pytest.mark.parametrize("name", UNARY)
def test_one_geometry(spark, shapes, name):
    got = spark.sql(f"SELECT id, {name}(geometry) AS r FROM shapes ORDER BY id").collect()
    assert got == shapes.select("id", getattr(G, name)("geometry").alias("r")).orderBy("id").collect()


def test_two_geometries_buffers_and_binary(spark, shapes):
    text = "SELECT id, st_distance(geometry, st_point(7D, 8D)) AS d, st_intersects(geometry, st_point(3D, 4D)) AS m FROM shapes ORDER BY id"
    columns = shapes.select("id", G.st_distance("geometry", wkt="POINT (7 8)").alias("d"), G.st_intersects("geometry", wkt="POINT (3 4)").alias("m"))
    assert spark.sql(text).collect() == columns.orderBy("id").collect()
    lines = "SELECT id, st_astext(st_geomfromwkb(st_aswkb(geometry))) AS t, st_area(st_buffer(geometry, 0.5)) AS a FROM shapes WHERE id IN (0, 2, 4) ORDER BY id"
    own = shapes.where("id IN (0, 2, 4)").select("id", G.st_astext("geometry").alias("t"), G.st_area(G.st_buffer("geometry", 0.5)).alias("a"))
    assert spark.sql(lines).collect() == own.orderBy("id").collect()
    mixed = spark.sql("SELECT id, st_area(st_buffer(geometry, CASE id WHEN 0 THEN 2 WHEN 2 THEN 1 END)) AS a FROM shapes WHERE id IN (0, 2, 4) ORDER BY id").collect()
    assert mixed[0].a > 12 and mixed[1].a > 20 and mixed[2].a is None


def test_lines_of_points(spark, shapes):
    got = spark.sql("SELECT st_astext(st_makeline(collect_list(st_point(x, x + 1D)))) AS t FROM (SELECT explode(array(1D, 2D)) AS x)").first()
    assert got.t == "LINESTRING (1 2, 2 3)"
    with pytest.raises(PySparkException, match="no vertex or at least two"):
        spark.sql("SELECT st_makeline(array(st_point(1D, 2D))) AS l").collect()


def test_geometry_of_text(spark, shapes):
    spark.createDataFrame(list(enumerate(SHAPES)), "id int, t string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT id, st_geomfromwkt(t) AS geometry FROM texts ORDER BY id").collect() == shapes.orderBy("id").collect()
    for bad in ("POINT (1)", "POLYGON ((0 0, 1 0, 1 1, 2 2))"):
        with pytest.raises(PySparkException, match="not a geometry text"):
            spark.sql(f"SELECT st_geomfromwkt(concat('{bad}', substr(t, 1, 0))) AS g FROM texts WHERE id = 0").collect()
    window = "st_geomfromwkt('POLYGON((0 0, 5 0, 5 5, 0 5, 0 0))')"
    assert [r.id for r in spark.sql(f"SELECT id FROM shapes WHERE st_intersects(geometry, {window}) ORDER BY id").collect()] == [0, 2, 3, 4, 6, 7, 9]
