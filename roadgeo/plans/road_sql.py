"""The road query catalogue as SQL text over a view of the ways, ``osm_data``.

``register_roads(spark, ways)`` makes the view, the geometry functions and the table function ``near_pairs`` known; every
text of ``TEXTS`` then runs as it stands. Where a query limits without an order, its rows are taken in id order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadgeo.functions.sql import register_functions
from roadgeo.plans.road_queries import (
    BUFFER_DISTANCE,
    BUFFER_ROW_LIMIT,
    MAJOR_ROADS,
    MANY_POINTS,
    NEARBY_DISTANCE,
    ROW_LIMIT,
    WINDOW,
)

VIEW = "osm_data"

_BOX = ("xmin", "ymin", "xmax", "ymax")
_CELL = "STRUCT<cx: BIGINT, cy: BIGINT, x0: BIGINT, y0: BIGINT, xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>"


def _cells() -> str:
    """The cells that a box meets, each with the lowest ones of its row and column and with the box."""
    box = ", ".join(f"'{side}', array_{side[1:]}(transform(flatten(g.parts), v -> v.{side[0]}))" for side in _BOX)
    sides = ", ".join(f"'{side}', b.{side}" for side in _BOX)
    edge = lambda side, sign: f"b.{side} {sign} (margin + 1e-14D * abs(b.{side}))"
    first = {"x0": edge("xmin", "-"), "y0": edge("ymin", "-"), "x1": edge("xmax", "+"), "y1": edge("ymax", "+")}
    ends = ", ".join(f"'{name}', cast(floor(({at}) / cell) AS BIGINT)" for name, at in first.items())
    across = f"""transform(sequence(b.x0, b.x1), cx ->
      transform(sequence(b.y0, b.y1), cy -> named_struct('cx', cx, 'cy', cy, 'x0', b.x0, 'y0', b.y0, {sides})))"""
    boxes = f"filter(array(named_struct({box})), b -> b.xmin IS NOT NULL)"
    placed = f"transform({boxes}, b -> named_struct({ends}, {sides}))"
    return f"get(transform({placed}, b -> flatten({across})), 0)"


def _near(low: str, high: str) -> str:
    """Whether a low side of a box lies no farther than d above a high side of another. Rounding is allowed for."""
    return f"{low} - {high} <= d * (1 + 1e-9D) + 1e-14D * (abs({low}) + abs({high}))"


def _pairs() -> str:
    """Rows of the view meet in the cells of a grid, widened by half the distance; a pair counts in the first cell that both meet.

    Both sides are placed alike, so that one exchange serves both. Cells are much wider than the distance, so that few rows
    lie in several: what meets in one is mostly too far apart, and boxes decide that before the distance."""
    side = f"SELECT *, explode(cells) AS c FROM (SELECT *, st_cells(geometry, 0.5D * d * (1 + 1e-9D), 4 * d) AS cells FROM {VIEW})"
    near = " AND ".join(_near(f"{p}.c.{axis}min", f"{q}.c.{axis}max") for p, q in ("ab", "ba") for axis in "xy")
    # the distance comes out of an array: as a column that is filtered on, the optimizer would compute it twice
    return f"""
    SELECT id, tags, other_id, other_tags, distance FROM (
      SELECT a.id AS id, a.tags AS tags, a.geometry AS geometry, b.id AS other_id, b.tags AS other_tags, b.geometry AS other_geometry
      FROM ({side}) a JOIN ({side}) b
        ON a.c.cx = b.c.cx AND a.c.cy = b.c.cy AND a.id < b.id
        AND a.c.cx = greatest(a.c.x0, b.c.x0) AND a.c.cy = greatest(a.c.y0, b.c.y0)
        AND {near}
    ) LATERAL VIEW explode(filter(array(st_distance(geometry, other_geometry)), v -> v < d)) found AS distance"""


def register_roads(spark: SparkSession, ways: DataFrame) -> None:
    """Make ``osm_data``, the geometry functions and ``near_pairs(d)`` known to SQL text of this session.

    ``near_pairs`` gives (id, tags, other_id, other_tags, distance) of all rows nearer than ``d``, the lower id first. It
    is an equi join on grid cells, placed by whole boxes; ``distance_join`` also cuts long lines and crowded cells.
    """
    register_functions(spark)
    ways.createOrReplaceTempView(VIEW)
    shape = ways.schema["geometry"].dataType.simpleString()
    tags = ways.schema["tags"].dataType.simpleString()
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION st_cells(g {shape}, margin DOUBLE, cell DOUBLE) RETURNS ARRAY<{_CELL}> RETURN {_cells()}")
    columns = f"id BIGINT, tags {tags}, other_id BIGINT, other_tags {tags}, distance DOUBLE"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION near_pairs(d DOUBLE) RETURNS TABLE ({columns}) RETURN {_pairs()}")


_MAJOR = ", ".join(f"'{kind}'" for kind in MAJOR_ROADS)


def _first(n: int, condition: str = "true") -> str:
    """The rows of lowest id. The hint keeps the optimizer from computing what is selected above for every row."""
    return f"(SELECT /*+ COALESCE(1) */ * FROM (SELECT * FROM {VIEW} WHERE {condition} ORDER BY id LIMIT {n}))"


_FIRST = _first(ROW_LIMIT, "tags['name'] IS NOT NULL")
_LENGTHS = f"(SELECT *, st_length(geometry) AS length FROM {VIEW})"

TEXTS = {
    "q01": f"SELECT count(*) AS total_roads FROM {VIEW}",
    "q02": f"""
      SELECT count(*) AS road_count, sum(length) AS total_length, avg(length) AS avg_length, max(length) AS max_length
      FROM {_LENGTHS}""",
    "q03": f"""
      SELECT tags['highway'] AS highway_type, count(*) AS road_count, sum(length) AS total_length
      FROM {_LENGTHS} WHERE tags['highway'] IS NOT NULL GROUP BY 1 ORDER BY road_count DESC, highway_type""",
    "q04": f"""
      SELECT id, tags['name'] AS road_name, tags['highway'] AS highway_type, tags['lit'] AS lighting, length
      FROM {_LENGTHS} WHERE tags['lit'] = 'yes'""",
    "q05": f"""
      SELECT tags['surface'] AS surface_type, count(*) AS road_count, sum(length) AS total_length, avg(length) AS avg_length
      FROM {_LENGTHS} WHERE tags['surface'] IS NOT NULL GROUP BY 1 ORDER BY total_length DESC, surface_type""",
    "q06": f"SELECT id, tags['name'] AS road_name, st_envelope(geometry) AS bbox, st_length(geometry) AS length FROM {_FIRST}",
    "q07": f"""
      SELECT id, tags['name'] AS road_name, tags['highway'] AS highway_type, tags['ref'] AS road_ref, length
      FROM {_LENGTHS} WHERE tags['highway'] IN ({_MAJOR}) ORDER BY length DESC, id""",
    "q08": f"SELECT id, tags['name'] AS road_name, st_centroid(geometry) AS centroid, st_length(geometry) AS length FROM {_FIRST}",
    "q09": f"""
      SELECT id, tags['name'] AS road_name, tags['highway'] AS highway_type, tags['lanes'] AS num_lanes, length
      FROM {_LENGTHS} WHERE tags['name'] IS NOT NULL AND tags['lanes'] IS NOT NULL
      ORDER BY try_cast(num_lanes AS INT) DESC NULLS LAST, id""",
    "q10": f"""
      SELECT tags['highway'] AS highway_type, count(*) AS segment_count, sum(length) AS total_length,
        avg(length) AS avg_length, min(length) AS min_length, max(length) AS max_length,
        count_if(tags['lit'] = 'yes') AS lit_count, count_if(tags['surface'] = 'asphalt') AS asphalt_count
      FROM {_LENGTHS} WHERE tags['highway'] IS NOT NULL GROUP BY 1 ORDER BY total_length DESC, highway_type""",
    "q11": f"""
      SELECT *, st_area(buffer_geom) AS buffer_area
      FROM (
        SELECT id, tags['name'] AS road_name, st_buffer(geometry, {BUFFER_DISTANCE}D) AS buffer_geom, st_length(geometry) AS original_length
        FROM {_first(BUFFER_ROW_LIMIT, f"tags['highway'] IN ({_MAJOR})")})""",
    "q12": f"""
      SELECT id, tags['name'] AS road_name, tags['highway'] AS highway_type, st_length(geometry) AS length
      FROM {VIEW} WHERE st_intersects(geometry, st_geomfromwkt('{WINDOW}'))""",
    "q13": f"""
      SELECT id, tags['name'] AS road_name, st_startpoint(geometry) AS start_point, st_endpoint(geometry) AS end_point,
        st_length(geometry) AS length
      FROM {_first(ROW_LIMIT)}""",
    "q14": f"""
      SELECT id, tags['name'] AS road_name, tags['highway'] AS highway_type, num_points, length, length / num_points AS avg_segment_length
      FROM (SELECT *, st_numpoints(geometry) AS num_points FROM {_LENGTHS})
      WHERE num_points > {MANY_POINTS} ORDER BY num_points DESC, id LIMIT {ROW_LIMIT}""",
    "q15": f"""
      SELECT id AS road1_id, tags['name'] AS road1_name, other_id AS road2_id, other_tags['name'] AS road2_name, distance
      FROM near_pairs({NEARBY_DISTANCE}D) WHERE tags['name'] IS NOT NULL AND other_tags['name'] IS NOT NULL
      ORDER BY road1_id, road2_id LIMIT {ROW_LIMIT}""",
}


def run_text(spark: SparkSession, ways: DataFrame, name: str) -> DataFrame:
    """One of the texts over the ways."""
    register_roads(spark, ways)
    return spark.sql(TEXTS[name])
