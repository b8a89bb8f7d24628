"""Every operator as a named query over a directory of the given tables.

Geometry results are shown as plain columns, doubles are rounded to nine decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgeo import derived
from roadgeo.functions import (
    bbox,
    file_stem,
    st_area,
    st_astext,
    st_aswkb,
    st_buffer,
    st_centroid,
    st_distance,
    st_envelope,
    st_geomfromwkb,
    st_geomfromwkt,
    st_intersects,
    st_length,
    st_makeline,
    st_numpoints,
    st_point,
    st_x,
    st_y,
)
from roadgeo.operators import assembly, runs
from roadgeo.operators.distance_join import distance_join
from roadgeo.operators.range_filter import range_filter
from roadgeo.plans import road_queries as roads
from roadgeo.plans.road_sql import run_text
from roadgeo.sources import tables
from roadgeo.sources.geoparquet import geo_footers
from roadgeo.sources.gpx import read_gpx, track_name
from roadgeo.sources.osm import read_osm, stage_elements
from roadgeo.sources.pbf_sink import write_osm_pbf
from roadgeo.sources.scratch import discard, scratch_path, without_shuffle_files
from roadgeo.types import BBOX_COLUMNS, GEOMETRY

DIGITS = 9


def _r(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded, with -0.0 as 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def _rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({n: _r(n, digits) for n in names})


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _box(df: DataFrame, geom: str, names=BBOX_COLUMNS) -> DataFrame:
    """Replace a geometry column by the columns of its bounding box."""
    boxed = df.withColumn("_b", bbox(geom))
    return boxed.withColumns({n: F.col(f"_b.{c}") for n, c in zip(names, BBOX_COLUMNS)}).drop(
        "_b", geom
    )


def _xy(df: DataFrame, geom: str, x: str, y: str) -> DataFrame:
    return df.withColumns({x: st_x(geom), y: st_y(geom)}).drop(geom)


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.elements(spark, sf_dir)


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.ways(_elements(spark, sf_dir))


def _stored_ways(spark: SparkSession, sf_dir: str, *keep_tags: str) -> DataFrame:
    """The ways assembled once and stored with their boxes, for the joins, which read each side twice: once to count crowded
    tiles, from the boxes alone. Of the tags only those named are taken along.

    Elements and vertices are stored on the way, so that the shuffle files of one step go before the next one begins."""
    tags = F.map_filter("tags", lambda k, _: k.isin(*keep_tags))
    elements = _elements(spark, sf_dir).filter("kind <> 'relation'").withColumn("tags", tags)
    on_the_way = [scratch_path(spark, name) for name in ("elements", "vertices")]
    path = scratch_path(spark, "ways")
    with without_shuffle_files(spark):
        staged = stage_elements(elements, on_the_way[0])
        assembly.way_vertices(staged).write.parquet(on_the_way[1])
        lines = assembly.ways(staged, vertices=spark.read.parquet(on_the_way[1]))
        tables.write_geometry_parquet(lines, path, keep_tags=keep_tags)
    discard(spark, *on_the_way)
    return tables.read_geometry_parquet(spark, path)


def _road_query(fn, shape=lambda df: df, ways=_ways):
    return lambda spark, sf_dir: _rounded(shape(fn(ways(spark, sf_dir))))


def _road_text(name, shape=lambda df: df, ways=_ways):
    """A road query by its SQL text."""
    return lambda spark, sf_dir: _rounded(shape(run_text(spark, ways(spark, sf_dir), name[:3])))


def _stored_names(spark, sf_dir):
    return _stored_ways(spark, sf_dir, "name")


# ---------------------------------------------------------------- assembly


def osm_points(spark, sf_dir):
    found = assembly.points(_elements(spark, sf_dir))
    return _xy(found.select("id", "geometry"), "geometry", "x", "y")


def osm_points_strict(spark, sf_dir):
    """Strict points over the located nodes, which must all pass."""
    located = _elements(spark, sf_dir).filter("kind <> 'node' or location is not null")
    found = assembly.points(located, strict=True)
    return _xy(found.select("id", "geometry"), "geometry", "x", "y")


def osm_drop_counts(spark, sf_dir):
    """What the assembly of both tables drops, with clustered rows."""
    out = scratch_path(spark, "roads")
    elements = stage_elements(_elements(spark, sf_dir), scratch_path(spark, "elements"))
    dropped = tables.build_road_tables(elements, out, "derived", cluster_cell=0.05)
    counts = spark.read.parquet(f"{out}/derived_ways.parquet").agg(F.count("*").alias("ways"))
    return counts.select("ways", *(F.lit(n).cast("bigint").alias(k) for k, n in dropped.items()))


def osm_points_dropped(spark, sf_dir):
    """Nodes of the element table that give no point."""
    elements = _elements(spark, sf_dir)
    kept = assembly.points(elements).select("id")
    nodes = assembly.of_kind(elements, "node").select("id")
    return nodes.join(kept, "id", "left_anti")


def osm_ways(spark, sf_dir):
    lines = _ways(spark, sf_dir)
    return _rounded(
        lines.select(
            "id",
            *[F.col("tags")[k].alias(k) for k in ("highway", "name", "lit", "surface")],
            *[F.col("tags")[k].alias(k) for k in ("lanes", "ref")],
            st_numpoints("geometry").cast("bigint").alias("n_points"),
            st_length("geometry").alias("length"),
        )
    )


def osm_ways_complete(spark, sf_dir):
    lines = assembly.ways(_elements(spark, sf_dir), require_complete=True)
    return _rounded(
        lines.select(
            F.col("id").alias("osm_id"),
            st_numpoints("geometry").cast("bigint").alias("n_points"),
            st_length("geometry").alias("length"),
        )
    )


def osm_way_vertices(spark, sf_dir):
    return _long(assembly.way_vertices(_elements(spark, sf_dir)), "pos")


def osm_ways_dropped(spark, sf_dir):
    """Ways of the element table that give no line."""
    elements = _elements(spark, sf_dir)
    kept = assembly.ways(elements).select("id")
    all_ways = assembly.of_kind(elements, "way").select(
        "id", F.coalesce(F.array_size("refs"), F.lit(0)).cast("bigint").alias("n_refs")
    )
    return all_ways.join(kept, "id", "left_anti")


def _members(spark, sf_dir, members):
    found = assembly.relation_members(_elements(spark, sf_dir), members)
    return _rounded(
        found.select(
            "id",
            "ref",
            "ref_type",
            F.col("tags")["type"].alias("relation_type"),
            st_length("geometry").alias("length"),
        )
    )


def export_ways(spark, sf_dir):
    """Export form, written as well-known binary and read back."""
    path = scratch_path(spark, "export")
    tables.export_wkb(_ways(spark, sf_dir), path)
    back = tables.read_geometry_parquet(spark, path)
    return _rounded(
        back.select(
            "osm_id", F.col("tags")["name"].alias("name"), st_length("geometry").alias("length")
        )
    )


# ---------------------------------------------------------------- functions


def way_wkt(spark, sf_dir):
    return _ways(spark, sf_dir).select("id", st_astext("geometry").alias("wkt"))


def point_wkt(spark, sf_dir):
    """The text of every point."""
    return assembly.points(_elements(spark, sf_dir)).select("id", st_astext("geometry").alias("wkt"))


def wkt_roundtrip(spark, sf_dir):
    lines = _ways(spark, sf_dir).withColumn("back", st_geomfromwkt(st_astext("geometry")))
    return _rounded(
        lines.select(
            "id",
            (F.col("back") == F.col("geometry")).alias("same"),
            st_length("back").alias("length"),
        )
    )


def wkb_roundtrip(spark, sf_dir):
    coded = _ways(spark, sf_dir).select("id", "geometry", st_aswkb("geometry").alias("wkb"))
    back = coded.withColumn("back", st_geomfromwkb("wkb"))
    return back.select(
        "id",
        (F.col("back") == F.col("geometry")).alias("same"),
        F.length("wkb").cast("bigint").alias("n_bytes"),
    )


def wkb_types(spark, sf_dir):
    """Each road as one of the six types, through well-known binary without and with a reference system in its head."""
    v = F.get("geometry.parts", F.lit(0))
    ring = F.concat(v, F.slice(v, 1, 1))
    shapes = {
        "POINT": F.array(F.slice(v, 1, 1)),
        "LINESTRING": F.array(v),
        "POLYGON": F.array(ring),
        "MULTIPOINT": F.transform(v, lambda p: F.array(p)),
        "MULTILINESTRING": F.array(v, F.reverse(v)),
        "MULTIPOLYGON": F.array(ring, ring),
    }
    made = F.lit(None).cast(GEOMETRY)
    for nth, (kind, parts) in enumerate(shapes.items()):
        one = F.struct(F.lit(kind).alias("type"), parts.alias("parts"))
        made = F.when(F.col("id") % 6 == nth, one).otherwise(made)
    coded = _ways(spark, sf_dir).select("id", made.alias("g")).withColumn("wkb", st_aswkb("g"))
    # byte order and type, the flag that a reference system follows, its number, and the rest
    extended = F.concat(F.substring("wkb", 1, 4), F.unhex(F.lit("20E6100000")), F.expr("substring(wkb, 6)"))
    back = coded.withColumns({"back": st_geomfromwkb("wkb"), "again": st_geomfromwkb(extended)})
    return _rounded(
        back.select(
            "id",
            F.col("back.type").alias("type"),
            F.length("wkb").cast("bigint").alias("n_bytes"),
            (F.col("back") == F.col("g")).alias("same"),
            (F.col("again") == F.col("g")).alias("same_extended"),
            st_length("back").alias("length"),
        )
    )


def make_line(spark, sf_dir):
    """Line between the two corners of each road's box, made of points."""
    boxes = _box(_ways(spark, sf_dir).select("id", "geometry"), "geometry")
    ends = F.array(st_point("xmin", "ymin"), st_point("xmax", "ymax"))
    return _rounded(boxes.select("id", st_length(st_makeline(ends)).alias("diagonal")))


def polygon_area(spark, sf_dir):
    """Area and centroid of each road's envelope, and its area as a line."""
    boxes = _ways(spark, sf_dir).select("id", "geometry", st_envelope("geometry").alias("box"))
    shown = boxes.select(
        "id",
        F.col("box.type").alias("box_type"),
        st_area("box").alias("box_area"),
        st_area("geometry").alias("line_area"),
        st_centroid("box").alias("c"),
    )
    return _rounded(_xy(shown, "c", "cx", "cy"), 12)


def road_buffers(spark, sf_dir):
    """Buffer of every road of two vertices, where the area has a closed form."""
    short = _ways(spark, sf_dir).filter(st_numpoints("geometry") == 2)
    return _rounded(
        short.select("id", st_area(st_buffer("geometry", 0.001)).alias("buffer_area")), 12
    )


def point_line_distance(spark, sf_dir):
    """Distance of each road to the point it would start at without its detours."""
    anchor = st_point(F.lit(15.9) + F.col("id") % 100 * 0.004, F.lit(45.8))
    return _rounded(
        _ways(spark, sf_dir).select("id", st_distance("geometry", anchor).alias("distance"))
    )


def intersects_window_pairs(spark, sf_dir):
    """Roads against a slanted window each, as two columns."""
    x, y = F.lit(15.9) + F.col("id") % 100 * 0.004, F.lit(45.8) + F.expr("id div 100") * 0.004

    def corner(dx, dy):
        return F.struct((x + dx).alias("x"), (y + dy).alias("y"))

    # corners off every line through two nodes: a touch there would be decided by rounding
    first = corner(0.0000513171, 0.0000377393)
    ring = F.array(first, corner(0.0020533719, 0.0010417153), corner(0.0010291733, 0.0030435927), first)
    window = F.struct(F.lit("POLYGON").alias("type"), F.array(ring).alias("parts"))
    return _ways(spark, sf_dir).select(
        "id", st_intersects("geometry", window).alias("intersects")
    )


# ---------------------------------------------------------------- joins and filters


def distance_join_all(spark, sf_dir):
    return _rounded(roads.nearby_roads(_stored_names(spark, sf_dir)))


def distance_join_close(spark, sf_dir):
    """Pairs of lit and unlit roads, two different sides."""
    lines = _stored_ways(spark, sf_dir, "lit")
    lit = lines.filter(F.col("tag_lit") == "yes").select("id", "geometry", *BBOX_COLUMNS)
    dark = lines.filter(F.col("tag_lit") == "no").select("id", "geometry", *BBOX_COLUMNS)
    return _rounded(distance_join(lit, dark, 0.002))


def range_filter_bbox(spark, sf_dir):
    """Window filter over a stored table, where it prunes on the box columns."""
    path = scratch_path(spark, "ways")
    tables.write_geometry_parquet(_ways(spark, sf_dir), path, cluster_cell=0.05)
    stored = tables.read_geometry_parquet(spark, path)
    found = range_filter(stored, roads.WINDOW)
    return _rounded(found.select("id", *BBOX_COLUMNS))


# ---------------------------------------------------------------- sources and sinks


def _plain_time() -> Column:
    """Time as a date and clock time, the type it has in the given tables."""
    return F.col("time").cast("timestamp_ntz").alias("time")


def track_points(spark, sf_dir):
    points = derived.vehicles(spark, sf_dir)
    return points.select(
        "lat", "lon", "track", _plain_time(), st_x("geometry").alias("x"), st_y("geometry").alias("y")
    )


def gpx_roundtrip(spark, sf_dir):
    """The track points written as GPX, a track per user, and read back. A track is one element by its format."""
    point = F.struct(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "time")
    in_order = F.sort_array(F.collect_list(F.struct("event_id", point.alias("p"))))
    documents = (
        derived.vehicles(spark, sf_dir, "event_id")
        .groupBy(F.col("track").alias("name"))
        .agg(in_order.alias("p"))
        .select(
            "name",
            F.array(
                F.struct(F.transform("p", lambda p: p["p"]).alias("trkpt"))
            ).alias("trkseg"),
        )
    )
    path = scratch_path(spark, "tracks")
    documents.write.format("xml").options(
        rootTag="gpx", rowTag="trk", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).save(path)
    return read_gpx(spark, path, "*.xml").select("lat", "lon", "track", _plain_time())


def write_osm_xml(elements: DataFrame, path: str) -> None:
    """Elements as OSM XML files, in the layout that ``read_osm`` expects."""
    tag = F.transform(
        F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))
    ).alias("tag")
    own = {
        "node": [
            F.col("location.latitude").alias("_lat"),
            F.col("location.longitude").alias("_lon"),
        ],
        "way": [F.transform("refs", lambda r: F.struct(r.alias("_ref"))).alias("nd")],
        "relation": [
            F.transform(
                F.arrays_zip("ref_types", "refs"),
                lambda m: F.struct(m["ref_types"].alias("_type"), m["refs"].alias("_ref")),
            ).alias("member")
        ],
    }
    for kind, columns in own.items():
        rows = assembly.of_kind(elements, kind).select(F.col("id").alias("_id"), *columns, tag)
        rows.write.mode("append").format("xml").options(rootTag="osm", rowTag=kind).save(path)


def osm_xml_roundtrip(spark, sf_dir):
    """Elements written as OSM XML, read back in ranges and assembled."""
    path = scratch_path(spark, "derived.osm")
    write_osm_xml(_elements(spark, sf_dir), path)
    staged = stage_elements(read_osm(spark, path), scratch_path(spark, "elements"))
    return _rounded(
        assembly.ways(staged).select(
            "id",
            F.col("tags")["name"].alias("name"),
            F.col("tags")["lanes"].alias("lanes"),
            st_numpoints("geometry").cast("bigint").alias("n_points"),
            st_length("geometry").alias("length"),
        )
    )


def osm_pbf_roundtrip(spark, sf_dir):
    """Elements written as OSM PBF, read back by byte ranges and assembled: each scan reads one kind."""
    path = scratch_path(spark, "derived.osm.pbf")
    write_osm_pbf(_elements(spark, sf_dir), path)
    found = assembly.relation_members(read_osm(spark, path), "way")
    return _rounded(
        found.select(
            "id",
            "ref",
            "ref_type",
            F.col("tags")["type"].alias("relation_type"),
            st_length("geometry").alias("length"),
        )
    )


def track_name_fallback(spark, sf_dir):
    """Track names where every seventh track has no name and every fifth an empty one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("user_id") % 7 == 0, F.lit(None)).otherwise(
        F.when(F.col("user_id") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("user "), F.col("user_id"))
        )
    )
    file = F.concat(F.lit("day."), F.col("event_id") % 9, F.lit(" log.gpx"))
    return events.select("event_id", track_name(name, file).alias("track"))


def file_stems(spark, sf_dir):
    """Stem and last suffix of the page addresses."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", file_stem("url").alias("stem"))


def parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "derived")
    tables.build_road_tables(
        _elements(spark, sf_dir), path, "derived", keep_tags=("highway", "lit"), cluster_cell=0.05
    )
    stored = tables.read_dataset(spark, f"{path}/derived_ways.parquet", "parquet", "osm_data")
    return _rounded(
        stored.select(
            "id",
            "tag_highway",
            "tag_lit",
            *BBOX_COLUMNS,
            F.col("n_points").cast("bigint").alias("n_points"),
            st_length("geometry").alias("length"),
        )
    )


def parquet_geo_roundtrip(spark, sf_dir):
    """Roads written as GeoParquet and read back, each beside what the footer of its file says."""
    path = scratch_path(spark, "ways.parquet")
    tables.write_geometry_parquet(_ways(spark, sf_dir), path, encoding="wkb", cluster_cell=0.05)
    stored = tables.read_geometry_parquet(spark, path).withColumn("file_name", F.col("_metadata.file_name"))
    footers = geo_footers(spark, path).select(
        "file_name", "encoding", "geometry_types", *[F.col(c).alias(f"file_{c}") for c in BBOX_COLUMNS]
    )
    inside = (
        (F.col("file_xmin") <= F.col("xmin")) & (F.col("file_ymin") <= F.col("ymin"))
        & (F.col("file_xmax") >= F.col("xmax")) & (F.col("file_ymax") >= F.col("ymax"))
    )
    return _rounded(
        stored.join(footers, "file_name").select(
            "id",
            st_length("geometry").alias("length"),
            "encoding",
            F.array_join("geometry_types", ",").alias("types"),
            inside.alias("inside_file_box"),
        )
    )


def parquet_points(spark, sf_dir):
    path = scratch_path(spark, "points.parquet")
    tables.write_geometry_parquet(
        assembly.points(_elements(spark, sf_dir)), path, encoding="wkb", cluster_cell=0.05
    )
    stored = tables.read_geometry_parquet(spark, path)
    return _xy(stored.select("id", "geometry"), "geometry", "x", "y")


def json_result_no_geometry(spark, sf_dir):
    path = scratch_path(spark, "result")
    tables.write_result_json(roads.envelope_bbox(_ways(spark, sf_dir)), path)
    return _rounded(spark.read.schema("id BIGINT, road_name STRING, length DOUBLE").json(path))


def json_result_all(spark, sf_dir):
    """A result with a geometry for every road, written without it, and read back."""
    path = scratch_path(spark, "result")
    boxes = _ways(spark, sf_dir).select(
        "id", F.col("tags")["name"].alias("road_name"), st_envelope("geometry").alias("bbox"), st_length("geometry").alias("length")
    )
    tables.write_result_json(boxes, path)
    back = spark.read.json(path)
    return _rounded(back.select("id", "road_name", "length", F.lit("bbox" in back.columns).alias("has_geometry")))


# ---------------------------------------------------------------- run statistics


def run_timing(spark, sf_dir):
    return _rounded(runs.run_timing(derived.numbered_runs(spark, sf_dir)))


def run_summary(spark, sf_dir):
    return _rounded(runs.run_summary(derived.runs(spark, sf_dir)))


def timing_json(spark, sf_dir):
    path = scratch_path(spark, "timing")
    tables.write_result_json(runs.run_timing(derived.numbered_runs(spark, sf_dir)), path)
    schema = (
        "query STRING, run BIGINT, execution_time DOUBLE, "
        "avg_time DOUBLE, min_time DOUBLE, max_time DOUBLE"
    )
    return _rounded(spark.read.schema(schema).json(path))


def run_mean_sorted(spark, sf_dir):
    return _rounded(runs.run_means(derived.runs(spark, sf_dir)))


def run_box_stats(spark, sf_dir):
    return _rounded(runs.run_box_stats(derived.runs(spark, sf_dir)))


def run_points(spark, sf_dir):
    return runs.run_points(derived.numbered_runs(spark, sf_dir))


def frame_diff(spark, sf_dir):
    """What changes in the lit roads when street lamps of one district go out."""
    lines = _ways(spark, sf_dir)
    before = roads.lit_roads(lines).select("id", "road_name", "lighting")
    dark = F.when(F.col("id") % 50 == 0, F.lit("no")).otherwise(F.col("lighting"))
    return runs.frame_diff(before, before.withColumn("lighting", dark))


def result_fingerprint(spark, sf_dir):
    """A result, and the same rows in another order and partitioning, have one fingerprint."""
    result = roads.lit_roads(_ways(spark, sf_dir))
    again = result.repartition(7, "road_name").sortWithinPartitions("length")
    both = runs.fingerprint(result).unionByName(runs.fingerprint(again))
    return both.agg(
        F.min("n_rows").alias("n_rows"),
        (F.min("fingerprint") == F.max("fingerprint")).alias("same"),
    )


def run_agreement(spark, sf_dir):
    return runs.run_agreement(derived.runs(spark, sf_dir))


def parameter_sweep(spark, sf_dir):
    """Roads at least as long as each of several limits, in one job."""
    limits = [{"least": v} for v in (0.001, 0.002, 0.005, 0.01)]
    lengths = _ways(spark, sf_dir).select(st_length("geometry").alias("length"))

    def count_long(df: DataFrame) -> DataFrame:
        return (
            df.filter(F.col("length") >= F.col("param.least"))
            .groupBy(F.col("param.least").alias("least"))
            .agg(F.count(F.lit(1)).alias("roads"), F.sum("length").alias("total_length"))
        )

    return _rounded(runs.parameter_sweep(lengths, limits, count_long))


def sql_sweep(spark, sf_dir):
    """A query text run for several highway types."""
    _ways(spark, sf_dir).createOrReplaceTempView("osm_data")
    return runs.sql_sweep(
        spark,
        "SELECT count(*) AS roads FROM osm_data WHERE tags['highway'] = :highway",
        [{"highway": h} for h in roads.MAJOR_ROADS],
    )


#: The road queries, and how their geometry columns are shown.
ROADS = {
    "q01_count_roads": (roads.count_roads,),
    "q02_road_length": (roads.road_length,),
    "q03_roads_by_highway_type": (roads.roads_by_highway_type,),
    "q04_lit_roads": (roads.lit_roads,),
    "q05_roads_by_surface": (roads.roads_by_surface,),
    "q06_envelope_bbox": (roads.envelope_bbox, lambda df: _box(df, "bbox")),
    "q07_major_roads": (roads.major_roads,),
    "q08_road_centroids": (roads.road_centroids, lambda df: _xy(df, "centroid", "cx", "cy")),
    "q09_named_roads_with_lanes": (roads.named_roads_with_lanes,),
    "q10_road_statistics": (roads.road_statistics,),
    "q11_buffer_analysis": (roads.buffer_analysis, lambda df: _box(df, "buffer_geom")),
    "q12_spatial_filter": (roads.spatial_filter,),
    "q13_start_end_points": (
        roads.start_end_points,
        lambda df: _xy(_xy(df, "start_point", "sx", "sy"), "end_point", "ex", "ey"),
    ),
    "q14_road_complexity": (roads.road_complexity, lambda df: _long(df, "num_points")),
    "q15_self_join_nearby": (roads.self_join_nearby, lambda df: df, _stored_names),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _road_query(*how) for name, how in ROADS.items()},
    **{f"sql_{name}": _road_text(name, *how[1:]) for name, how in ROADS.items()},
    "osm_points": osm_points,
    "osm_points_strict": osm_points_strict,
    "osm_points_dropped": osm_points_dropped,
    "osm_drop_counts": osm_drop_counts,
    "osm_ways": osm_ways,
    "osm_ways_complete": osm_ways_complete,
    "osm_ways_dropped": osm_ways_dropped,
    "osm_way_vertices": osm_way_vertices,
    "osm_relation_members_way": lambda spark, sf_dir: _members(spark, sf_dir, "way"),
    "osm_relation_members_any": lambda spark, sf_dir: _members(spark, sf_dir, "any"),
    "export_ways": export_ways,
    "way_wkt": way_wkt,
    "point_wkt": point_wkt,
    "wkt_roundtrip": wkt_roundtrip,
    "wkb_roundtrip": wkb_roundtrip,
    "wkb_types": wkb_types,
    "make_line": make_line,
    "polygon_area": polygon_area,
    "road_buffers": road_buffers,
    "point_line_distance": point_line_distance,
    "intersects_window_pairs": intersects_window_pairs,
    "distance_join_all": distance_join_all,
    "distance_join_close": distance_join_close,
    "range_filter_bbox": range_filter_bbox,
    "track_points": track_points,
    "gpx_roundtrip": gpx_roundtrip,
    "osm_xml_roundtrip": osm_xml_roundtrip,
    "osm_pbf_roundtrip": osm_pbf_roundtrip,
    "track_name_fallback": track_name_fallback,
    "file_stem": file_stems,
    "parquet_roundtrip": parquet_roundtrip,
    "parquet_geo_roundtrip": parquet_geo_roundtrip,
    "parquet_points": parquet_points,
    "json_result_no_geometry": json_result_no_geometry,
    "json_result_all": json_result_all,
    "run_timing": run_timing,
    "run_summary": run_summary,
    "timing_json": timing_json,
    "run_mean_sorted": run_mean_sorted,
    "run_box_stats": run_box_stats,
    "run_points": run_points,
    "frame_diff": frame_diff,
    "result_fingerprint": result_fingerprint,
    "run_agreement": run_agreement,
    "parameter_sweep": parameter_sweep,
    "sql_sweep": sql_sweep,
}
