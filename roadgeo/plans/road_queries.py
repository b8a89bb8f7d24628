"""The road query catalogue: each function takes the ways table and returns a DataFrame.

Where the catalogue limits without an order, rows are taken in id order, so that every run gives
the same answer. Stored columns of ``write_geometry_parquet`` (bounding box, vertex count, tags
kept as columns) are used where the table has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgeo.functions import (
    st_area,
    st_buffer,
    st_centroid,
    st_endpoint,
    st_envelope,
    st_length,
    st_numpoints,
    st_startpoint,
)
from roadgeo.operators.distance_join import distance_join, first_pairs
from roadgeo.operators.range_filter import range_filter
from roadgeo.types import BBOX_COLUMNS

# Fixed values of the query catalogue.
MAJOR_ROADS = ("primary", "secondary", "tertiary")
WINDOW = "POLYGON((15.94 45.81, 15.95 45.81, 15.95 45.83, 15.94 45.83, 15.94 45.81))"
BUFFER_DISTANCE = 0.001
NEARBY_DISTANCE = 0.01
MANY_POINTS = 10
ROW_LIMIT = 100
BUFFER_ROW_LIMIT = 50



def tag(roads: DataFrame, key: str) -> Column:
    """Value of a tag: from its own column ``tag_<key>`` if stored, else from the map."""
    column = f"tag_{key}"
    return F.col(column) if column in roads.columns else F.col("tags")[key]


def _length() -> Column:
    return st_length("geometry").alias("length")


def _named(roads: DataFrame) -> DataFrame:
    return roads.filter(tag(roads, "name").isNotNull())


def _major(roads: DataFrame) -> DataFrame:
    return roads.filter(tag(roads, "highway").isin(*MAJOR_ROADS))


def _name(roads: DataFrame) -> Column:
    return tag(roads, "name").alias("road_name")


def _highway(roads: DataFrame) -> Column:
    return tag(roads, "highway").alias("highway_type")


def count_roads(roads: DataFrame) -> DataFrame:
    return roads.agg(F.count(F.lit(1)).alias("total_roads"))


def road_length(roads: DataFrame) -> DataFrame:
    return roads.select(_length()).agg(
        F.count(F.lit(1)).alias("road_count"),
        F.sum("length").alias("total_length"),
        F.avg("length").alias("avg_length"),
        F.max("length").alias("max_length"),
    )


def roads_by_highway_type(roads: DataFrame) -> DataFrame:
    return (
        roads.filter(tag(roads, "highway").isNotNull())
        .select(_highway(roads), _length())
        .groupBy("highway_type")
        .agg(F.count(F.lit(1)).alias("road_count"), F.sum("length").alias("total_length"))
        .orderBy(F.desc("road_count"), "highway_type")
    )


def lit_roads(roads: DataFrame) -> DataFrame:
    lit = tag(roads, "lit")
    return roads.filter(lit == "yes").select(
        "id", _name(roads), _highway(roads), lit.alias("lighting"), _length()
    )


def roads_by_surface(roads: DataFrame) -> DataFrame:
    surface = tag(roads, "surface")
    return (
        roads.filter(surface.isNotNull())
        .select(surface.alias("surface_type"), _length())
        .groupBy("surface_type")
        .agg(
            F.count(F.lit(1)).alias("road_count"),
            F.sum("length").alias("total_length"),
            F.avg("length").alias("avg_length"),
        )
        .orderBy(F.desc("total_length"), "surface_type")
    )


def _first_by_id(roads: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of lowest id, as one small partition.

    The optimizer would move a projection below the limit and so run it on every row; it does not
    move it below a coalesce.
    """
    return roads.orderBy("id").limit(n).coalesce(1)


def envelope_bbox(roads: DataFrame) -> DataFrame:
    return _first_by_id(_named(roads), ROW_LIMIT).select(
        "id", _name(roads), st_envelope("geometry").alias("bbox"), _length()
    )


def major_roads(roads: DataFrame) -> DataFrame:
    return (
        _major(roads)
        .select(
            "id", _name(roads), _highway(roads), tag(roads, "ref").alias("road_ref"), _length()
        )
        .orderBy(F.desc("length"), "id")
    )


def road_centroids(roads: DataFrame) -> DataFrame:
    return _first_by_id(_named(roads), ROW_LIMIT).select(
        "id", _name(roads), st_centroid("geometry").alias("centroid"), _length()
    )


def named_roads_with_lanes(roads: DataFrame) -> DataFrame:
    lanes = tag(roads, "lanes")
    return (
        _named(roads)
        .filter(lanes.isNotNull())
        .select("id", _name(roads), _highway(roads), lanes.alias("num_lanes"), _length())
        # a column of its own: a sort evaluates its keys at every comparison
        .withColumn("number", F.col("num_lanes").try_cast("int"))
        .orderBy(F.col("number").desc_nulls_last(), "id")
        .drop("number")
    )


def road_statistics(roads: DataFrame) -> DataFrame:
    return (
        roads.filter(tag(roads, "highway").isNotNull())
        .select(
            _highway(roads),
            _length(),
            (tag(roads, "lit") == "yes").alias("is_lit"),
            (tag(roads, "surface") == "asphalt").alias("is_asphalt"),
        )
        .groupBy("highway_type")
        .agg(
            F.count(F.lit(1)).alias("segment_count"),
            F.sum("length").alias("total_length"),
            F.avg("length").alias("avg_length"),
            F.min("length").alias("min_length"),
            F.max("length").alias("max_length"),
            F.count_if("is_lit").alias("lit_count"),
            F.count_if("is_asphalt").alias("asphalt_count"),
        )
        .orderBy(F.desc("total_length"), "highway_type")
    )


def buffer_analysis(roads: DataFrame) -> DataFrame:
    return (
        _first_by_id(_major(roads), BUFFER_ROW_LIMIT)
        .select(
            "id",
            _name(roads),
            st_buffer("geometry", BUFFER_DISTANCE).alias("buffer_geom"),
            _length().alias("original_length"),
        )
        .withColumn("buffer_area", st_area("buffer_geom"))
    )


def spatial_filter(roads: DataFrame, window: str = WINDOW) -> DataFrame:
    return range_filter(roads, window).select(
        "id", _name(roads), _highway(roads), _length()
    )


def start_end_points(roads: DataFrame) -> DataFrame:
    return _first_by_id(roads, ROW_LIMIT).select(
        "id",
        _name(roads),
        st_startpoint("geometry").alias("start_point"),
        st_endpoint("geometry").alias("end_point"),
        _length(),
    )


def road_complexity(roads: DataFrame) -> DataFrame:
    stored = "n_points" in roads.columns
    num_points = F.col("n_points") if stored else st_numpoints("geometry")
    return (
        roads.filter(num_points > MANY_POINTS)
        .withColumn("num_points", num_points)
        .orderBy(F.desc("num_points"), "id")
        .limit(ROW_LIMIT)
        .coalesce(1)
        .select("id", _name(roads), _highway(roads), "num_points", _length())
        .withColumn("avg_segment_length", F.col("length") / F.col("num_points"))
    )


def _nearby_side(roads: DataFrame) -> DataFrame:
    named = _named(roads)
    boxes = [c for c in named.columns if c in BBOX_COLUMNS]
    return named.select("id", _name(named), "geometry", *boxes)


def _as_nearby(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.col("a_id").alias("road1_id"),
        F.col("a_road_name").alias("road1_name"),
        F.col("b_id").alias("road2_id"),
        F.col("b_road_name").alias("road2_name"),
        "distance",
    )


def nearby_roads(roads: DataFrame, distance: float = NEARBY_DISTANCE) -> DataFrame:
    """All pairs of named roads nearer than ``distance``, each pair once."""
    side = _nearby_side(roads)
    return _as_nearby(distance_join(side, side, distance, once=True))


def self_join_nearby(roads: DataFrame, distance: float = NEARBY_DISTANCE) -> DataFrame:
    """The first pairs of nearby named roads, by ids, of the whole join: each partition keeps its first ones."""
    side = _nearby_side(roads)
    return _as_nearby(first_pairs(side, side, distance, ROW_LIMIT, once=True))
