"""GPX track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgeo.functions import st_point, without_last_suffix

TRACK = (
    "name STRING, trkseg ARRAY<STRUCT<trkpt: ARRAY<STRUCT<"
    "_lat: DOUBLE, _lon: DOUBLE, time: STRING>>>>"
)


def file_name() -> Column:
    """Name of the file a row was read from, percent-encoding undone; ``+`` stays ``+``."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def track_name(name: Column, file: Column) -> Column:
    """Name of a track, or the file name without its last suffix if it has none."""
    return F.coalesce(F.nullif(name, F.lit("")), without_last_suffix(file))


def read_gpx(spark: SparkSession, path: str, pattern: str = "*.gpx") -> DataFrame:
    """Track points of the ``*.gpx`` files in a directory; other files are passed over.

    ``(lat, lon, track, time, geometry, file, seg, pos)``; ``seg`` and ``pos`` keep the order of
    the points within their track. Waypoints and routes are not read. Files are read by the
    executors, one track at a time.
    """
    tracks = (
        spark.read.format("xml")
        .option("rowTag", "trk")
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", pattern)
        .schema(TRACK)
        .load(path)
        .select("name", file_name().alias("file"), F.posexplode("trkseg").alias("seg", "s"))
    )
    return tracks.select(
        "name", "file", "seg", F.posexplode("s.trkpt").alias("pos", "p")
    ).select(
        F.col("p._lat").alias("lat"),
        F.col("p._lon").alias("lon"),
        track_name(F.col("name"), F.col("file")).alias("track"),
        F.col("p.time").cast("timestamp").alias("time"),
        st_point("p._lon", "p._lat").alias("geometry"),
        "file",
        "seg",
        "pos",
    )
