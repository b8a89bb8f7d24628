"""GeoParquet: well-known binary geometry, with the ``geo`` entry in the footer of every file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

from roadgeo.functions import st_geomfromwkb
from roadgeo.sources.files import PartFiles, file_sizes, open_file, refuse_existing
from roadgeo.types import BBOX_COLUMNS

# Fixed values of the format.
VERSION = "1.1.0"
TYPE_NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}

ROW_GROUP_BYTES = 64 << 20  # in memory, before encoding
IS_NULL = "_is_null_"  # before the name of a list or map column: whether it is null


def type_codes(wkb: pa.Array) -> set[int]:
    """Type numbers of little-endian well-known binary, from the heads of all values."""
    known = wkb.drop_null()
    offsets = np.frombuffer(known.buffers()[1], np.int32)[known.offset : known.offset + len(known)]
    if not len(offsets):
        return set()
    raw = np.frombuffer(known.buffers()[2], np.uint8)
    return set(raw[offsets[:, None] + np.arange(1, 5)].copy().view("<u4").ravel().tolist())


class GeoParquetWriter(PartFiles):
    """A file per task. Types and box are gathered while rows are written, and go to the footer when the file is closed."""

    suffix = ".parquet"

    def __init__(self, path: str, overwrite: bool, schema: pa.Schema):
        super().__init__(path, overwrite)
        self.schema = pa.schema([f.with_nullable(True) for f in schema if not f.name.startswith(IS_NULL)])

    def _as_given(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The columns of the table, with the nulls that ``_without_null_lists`` took out."""
        columns = []
        for f in self.schema:
            column = batch[f.name].cast(f.type)
            if IS_NULL + f.name in batch.schema.names:
                column = pc.if_else(batch[IS_NULL + f.name], pa.nulls(len(column), f.type), column)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)

    def fill(self, file, batches: Iterator[pa.RecordBatch]) -> None:
        codes: set[int] = set()
        box: list[float | None] = [None] * 4
        with pq.ParquetWriter(file, self.schema) as writer:
            held, size = [], 0
            for batch in batches:
                codes |= type_codes(batch["geometry"])
                box = _wider(box, batch)
                held.append(self._as_given(batch))
                size += batch.nbytes
                if size >= ROW_GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            writer.write_table(pa.Table.from_batches(held, self.schema))
            writer.add_key_value_metadata({"geo": json.dumps(_described(codes, box))})


def _wider(box: list, batch: pa.RecordBatch) -> list:
    """The box, made to hold a batch too. Rows without a box do not count."""
    for i, name in enumerate(BBOX_COLUMNS):
        side = pc.min_max(batch[name])["min" if i < 2 else "max"].as_py()
        if side is not None:
            box[i] = side if box[i] is None else (min if i < 2 else max)(box[i], side)
    return box


def _described(codes: set[int], box: list) -> dict:
    column = {"encoding": "WKB", "geometry_types": sorted(TYPE_NAMES[c] for c in codes)}
    if None not in box:
        column["bbox"] = box
    return {"version": VERSION, "primary_column": "geometry", "columns": {"geometry": column}}


def _without_null_lists(df: DataFrame) -> DataFrame:
    """Null lists and maps as empty ones, beside a column that tells them: after each row that Spark hands to Python it walks
    over all the null lists that its Arrow batch ends with, which takes the square of a batch's rows."""
    empty = {"array": F.array, "map": F.create_map}
    lists = {f.name: f.dataType for f in df.schema.fields if f.dataType.typeName() in empty}
    flags = [F.col(f"`{c}`").isNull().alias(IS_NULL + c) for c in lists]
    filled = {c: F.coalesce(F.col(f"`{c}`"), empty[t.typeName()]().cast(t)) for c, t in lists.items()}
    return df.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], *flags)


class GeoParquetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roadgeo_geoparquet_sink"

    def schema(self):
        return "geometry binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        from pyspark.sql.pandas.types import to_arrow_schema

        return GeoParquetWriter(self.options["path"], overwrite, to_arrow_schema(schema))


def write_geoparquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows with a ``geometry`` column of well-known binary and the columns of its box."""
    if not overwrite:
        refuse_existing(path)
    df.sparkSession.dataSource.register(GeoParquetSink)
    _without_null_lists(df).write.format(GeoParquetSink.name()).mode("overwrite" if overwrite else "append").save(path)


# ---------------------------------------------------------------- reading


def footer(path: str) -> dict | None:
    """The ``geo`` entry of one file, if it has one."""
    with open_file(path) as file:
        entries = pq.read_metadata(file).metadata or {}
    return json.loads(entries[b"geo"]) if b"geo" in entries else None


def dataset_footer(path: str) -> dict | None:
    """The ``geo`` entry of a table's first file, as the schema is that of one file, too."""
    files = [f for f, _ in file_sizes(path) if f.endswith(".parquet")]
    return footer(files[0]) if files else None


def _vertices(c: Column) -> Column:
    return F.transform(c, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def _shape(kind: str, parts: Column, c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(F.lit(kind).alias("type"), parts.alias("parts")))


#: How each encoding of the format becomes a geometry.
ENCODINGS = {
    "WKB": st_geomfromwkb,
    "point": lambda c: _shape("POINT", F.array(F.array(F.struct(c["x"].alias("x"), c["y"].alias("y")))), c),
    "linestring": lambda c: _shape("LINESTRING", F.array(_vertices(c)), c),
    "polygon": lambda c: _shape("POLYGON", F.transform(c, _vertices), c),
}


def decoded(df: DataFrame, geo: dict) -> DataFrame:
    """A table as its ``geo`` entry describes it: the primary column as ``geometry``, decoded."""
    name = geo["primary_column"]
    encoding = geo["columns"][name]["encoding"]
    if encoding not in ENCODINGS:
        raise ValueError(f"unsupported geometry encoding: {encoding}")
    if name != "geometry" and "geometry" in df.columns:
        raise ValueError(f"the primary column is {name}, but there is a column named geometry")
    return df.withColumn(name, ENCODINGS[encoding](F.col(f"`{name}`"))).withColumnRenamed(name, "geometry")


def geo_footers(spark: SparkSession, path: str) -> DataFrame:
    """The ``geo`` entry of every file, read by the executors: file_name, encoding, geometry_types and the box."""
    schema = "file_name string, encoding string, geometry_types array<string>, " + ", ".join(f"{c} double" for c in BBOX_COLUMNS)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["file"]:
                geo = footer(file)
                if geo is not None:
                    column = geo["columns"][geo["primary_column"]]
                    rows.append([file.rsplit("/", 1)[-1], column["encoding"], column["geometry_types"], *column.get("bbox", [None] * 4)])
            yield pd.DataFrame(rows, columns=["file_name", "encoding", "geometry_types", *BBOX_COLUMNS])

    files = spark.createDataFrame([(f,) for f, _ in file_sizes(path) if f.endswith(".parquet")], "file string")
    return files.repartition(spark.sparkContext.defaultParallelism, "file").mapInPandas(read, schema)
