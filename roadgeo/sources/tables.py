"""Geometry tables at rest: Parquet in and out, JSON results, named views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgeo.functions import bbox, st_astext, st_aswkb, st_geomfromwkb, st_numpoints
from roadgeo.operators import assembly
from roadgeo.sources.geoparquet import dataset_footer, decoded, write_geoparquet
from roadgeo.sources.gpx import read_gpx
from roadgeo.sources.scratch import scratch_path
from roadgeo.types import BBOX_COLUMNS, geometry_columns, is_geometry

# ---------------------------------------------------------------- reading


def read_geometry_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A GeoParquet table, or a Parquet table with a ``geometry`` column: the geometry struct, or well-known binary.

    What the ``geo`` entry of the footer says about the geometry column and its encoding is followed. Without such an
    entry, any other type of that column is an error.
    """
    df = spark.read.parquet(path)
    geo = dataset_footer(path)
    if geo is not None:
        return decoded(df, geo)
    if "geometry" not in df.columns:
        raise ValueError(f"no geometry column in {path}")
    data_type = df.schema["geometry"].dataType
    if isinstance(data_type, T.BinaryType):
        return df.withColumn("geometry", st_geomfromwkb("geometry"))
    if not is_geometry(data_type):
        raise ValueError(f"not a geometry column: {data_type.simpleString()}")
    return df


def read_dataset(spark: SparkSession, path: str, format: str, view_name: str) -> DataFrame:
    """Read a table by its declared format, ``parquet`` or ``gpx``, and register it as a view."""
    if format == "parquet":
        df = read_geometry_parquet(spark, path)
    elif format == "gpx":
        df = read_gpx(spark, path)
    else:
        raise ValueError(f"unsupported format: {format}")
    df.createOrReplaceTempView(view_name)
    return df


# ---------------------------------------------------------------- writing


def _spread_bits(c: Column) -> Column:
    """Bits of a number below 2**31 moved to the even places."""
    # The masks of each doubling step.
    masks = {
        16: 0x0000FFFF0000FFFF,
        8: 0x00FF00FF00FF00FF,
        4: 0x0F0F0F0F0F0F0F0F,
        2: 0x3333333333333333,
        1: 0x5555555555555555,
    }
    for shift, mask in masks.items():
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def z_order(x: Column, y: Column, cell: float) -> Column:
    """Z-order number of the grid cell holding a position."""

    def index(c: Column) -> Column:
        return (F.floor(c / F.lit(cell)) + F.lit(1 << 30)).cast("bigint")

    return _spread_bits(index(x)).bitwiseOR(F.shiftleft(_spread_bits(index(y)), 1))


def with_stored_columns(df: DataFrame, keep_tags: Sequence[str] = ()) -> DataFrame:
    """Add the columns that queries prune on: box, vertex count, and chosen tags as columns."""
    boxed = df.withColumn("_box", bbox("geometry"))
    return boxed.select(
        *df.columns,
        *[F.col(f"_box.{c}").alias(c) for c in BBOX_COLUMNS],
        st_numpoints("geometry").alias("n_points"),
        *[F.col("tags")[t].alias(f"tag_{t}") for t in keep_tags],
    )


def write_geometry_parquet(
    df: DataFrame,
    path: str,
    overwrite: bool = False,
    encoding: str = "struct",
    keep_tags: Sequence[str] = (),
    cluster_cell: float | None = None,
) -> None:
    """Write a geometry table; an existing target is an error unless ``overwrite``.

    The box, the vertex count and the tags named in ``keep_tags`` become columns of their own, so
    that filters on them reach the row groups. ``cluster_cell`` range-partitions and sorts rows
    along a z-order of grid cells, which makes those row groups tight; ties are broken by id, so a
    crowded cell spreads over several files. ``encoding="wkb"`` writes GeoParquet.
    """
    if encoding not in ("struct", "wkb"):
        raise ValueError(f"encoding must be 'struct' or 'wkb', not {encoding!r}")
    out = with_stored_columns(df, keep_tags)
    if cluster_cell:
        middle = [(F.col(lo) + F.col(hi)) / 2 for lo, hi in (("xmin", "xmax"), ("ymin", "ymax"))]
        key = [c for c in ("id", "osm_id") if c in df.columns]
        out = out.withColumn("_z", z_order(*middle, cluster_cell))
        out = out.repartitionByRange("_z", *key).sortWithinPartitions("_z", *key).drop("_z")
    if encoding == "wkb":
        write_geoparquet(out.withColumn("geometry", st_aswkb("geometry")), path, overwrite)
        return
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def export_wkb(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """Export ``(osm_id, tags, geometry)`` with well-known binary geometry."""
    out = assembly.as_export(table).withColumn("geometry", st_aswkb("geometry"))
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def result_columns(df: DataFrame, geometry: str = "drop") -> DataFrame:
    """A result without its geometry columns, or with them as text (``geometry="wkt"``)."""
    if geometry not in ("drop", "wkt"):
        raise ValueError(f"geometry must be 'drop' or 'wkt', not {geometry!r}")
    shapes = geometry_columns(df)
    if geometry == "drop":
        return df.drop(*shapes)
    return df.withColumns({c: st_astext(c) for c in shapes})


def write_result_json(
    df: DataFrame, path: str, geometry: str = "drop", overwrite: bool = False
) -> None:
    """Write a query result as JSON lines; see ``result_columns``."""
    mode = "overwrite" if overwrite else "errorifexists"
    result_columns(df, geometry).write.mode(mode).json(path)


def build_road_tables(
    elements: DataFrame,
    out_dir: str,
    stem: str,
    keep_tags: Sequence[str] = (),
    cluster_cell: float | None = None,
    strict: bool = False,
) -> dict[str, int]:
    """Write ``<stem>_points.parquet`` and ``<stem>_ways.parquet``; return the numbers dropped.

    The numbers are counted while the assembled rows are written for the first time. Clustering
    samples its input, which would run the assembly and the counts again, so it reads stored rows.
    """
    nodes, refs, short = Observation(), Observation(), Observation()
    base = f"{out_dir.rstrip('/')}/{stem}"

    def once(df: DataFrame, name: str) -> DataFrame:
        if not cluster_cell:
            return df
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    located = assembly.points(elements, strict=strict, dropped=None if strict else nodes)
    write_geometry_parquet(
        once(located, "points"), f"{base}_points.parquet", cluster_cell=cluster_cell
    )
    lines = once(assembly.ways(elements, without_refs=refs, too_short=short), "ways")
    write_geometry_parquet(
        lines, f"{base}_ways.parquet", keep_tags=keep_tags, cluster_cell=cluster_cell
    )
    observed = [refs, short] if strict else [nodes, refs, short]
    return {name: count for o in observed for name, count in o.get.items()}
