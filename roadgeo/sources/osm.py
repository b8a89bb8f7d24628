"""OSM element sources: XML and PBF extracts, and element tables staged as Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgeo.sources.osm_xml import OsmXmlSource
from roadgeo.sources.pbf import OsmPbfSource
from roadgeo.types import ELEMENTS


#: What an element of each kind may hold, besides its id and kind.
KIND_COLUMNS = {"node": ["tags", "location"], "way": ["tags", "refs"], "relation": ["tags", "refs", "ref_types"]}


def _read(spark: SparkSession, source, path: str, columns: Sequence[str], **options) -> DataFrame:
    spark.dataSource.register(source)
    schema = T.StructType([ELEMENTS[c] for c in columns])
    given = {k: v for k, v in options.items() if v is not None}
    return spark.read.format(source.name()).schema(schema).options(path=path, **given).load()


def read_osm_xml(
    spark: SparkSession, path: str, range_bytes: int | None = None, columns: Sequence[str] = tuple(ELEMENTS.fieldNames())
) -> DataFrame:
    """Elements of an OSM XML extract (a file, or a directory of files).

    Large files are split; ``range_bytes`` is the stretch of one task. Rows are made of ``columns`` only.
    """
    return _read(spark, OsmXmlSource, path, columns, range_bytes=range_bytes)


def read_osm_pbf(
    spark: SparkSession,
    path: str,
    range_bytes: int | None = None,
    columns: Sequence[str] = tuple(ELEMENTS.fieldNames()),
    by_kind: bool = True,
) -> DataFrame:
    """Elements of an OSM PBF extract (a file, or a directory of files).

    The driver lists files only; executors find the blobs of their ranges. ``by_kind`` reads each kind by a scan of its
    own, which passes over the groups of the others: a filter on ``kind`` then leaves the plan with the scans that it
    needs. Without it one scan reads all kinds, and no blob is inflated twice. Spark does not tell a Python source which
    columns a query reads: name them in ``columns``, and the others are not decoded.
    """
    if not by_kind:
        return _read(spark, OsmPbfSource, path, columns, range_bytes=range_bytes)
    scans = []
    for kind, own in KIND_COLUMNS.items():
        held = [c for c in columns if c in ("id", *own)] or ["id"]
        rows = _read(spark, OsmPbfSource, path, held, range_bytes=range_bytes, kinds=kind)
        absent = {c: F.lit(kind if c == "kind" else None).cast(ELEMENTS[c].dataType) for c in columns if c not in held}
        scans.append(rows.withColumns(absent).select(*columns) if absent else rows.select(*columns))
    # The empty table leaves the plan; it makes all columns nullable, as they are without by_kind.
    empty = spark.createDataFrame([], T.StructType([ELEMENTS[c] for c in columns]))
    return reduce(DataFrame.unionAll, scans, empty)


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements of an extract, by its suffix: ``.osm`` or ``.pbf``. A PBF extract is read by kind."""
    if path.endswith(".osm"):
        return read_osm_xml(spark, path)
    if path.endswith(".pbf"):
        return read_osm_pbf(spark, path)
    raise ValueError(f"unsupported file format: {path}")


def stage_elements(elements: DataFrame, path: str) -> DataFrame:
    """Write elements once, partitioned by kind, and read them back.

    Assembly scans the elements several times, each time one kind and few columns. Over this
    table those scans prune to that kind's files and columns, and nothing is decoded twice.
    """
    elements.write.partitionBy("kind").parquet(path)
    staged = elements.sparkSession.read.parquet(path)
    return staged.select(*[F.col(f.name).cast(f.dataType) for f in ELEMENTS.fields])
