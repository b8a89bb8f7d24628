"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadgeo.sources.scratch import scratch_path

#: Words are runs of anything but these bytes, which bytes.split() splits at too.
WHITE = r"[\x20\x09-\x0D]"
#: Remainder of crc32(doc_id) by 4 that no classifier may learn from.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: the lineage ends there, and a lost executor takes nothing along.

    The shuffle files of the write are of no use after it, and go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.staged_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Removes staged rows that nothing reads any more."""
    for df in stored:
        if path := getattr(df, "staged_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_batch(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str, at_once: int = 500) -> DataFrame:
    """Applies rows(*columns as lists), which gives result rows, to up to `at_once` rows at a time, from Arrow batches."""
    target = StructType.fromDDL(schema)
    names = target.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                out = list(rows(*(c.to_pylist() for c in batch.slice(start, at_once).columns)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=names)

    return df.mapInArrow(run, schema)


def by_arrays(df: DataFrame, arrays: Callable[..., list], schema: str, at_once: int = 2000) -> DataFrame:
    """Applies arrays(*columns as Arrow arrays), which gives numpy or Arrow arrays of equal length, to up to `at_once` rows at a time."""
    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                out = arrays(*batch.slice(start, at_once).columns)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, arrow)], names=arrow.names)

    return df.mapInArrow(run, schema)


def by_row(df: DataFrame, row: Callable[..., tuple], schema: str) -> DataFrame:
    """Applies row(*values), which gives a result row, to each row, in Arrow batches."""
    return by_batch(df, lambda *columns: map(row, *columns), schema)


def held_out(doc_id) -> F.Column:
    """Whether a document's label may not be learnt from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def partition_sums(df: DataFrame, add: Callable[[dict[str, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of add(columns of a batch), a vector of fixed size.

    Each partition adds up its own rows; the vectors meet in about as many groups as there are rows to a group, and then
    in one, so that no task and not the driver holds more than the square root of their number at once."""
    slots = max(1, math.isqrt(shuffle_partitions(df.sparkSession)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += add({c: batch[c].to_numpy() for c in batch.columns})
        yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % slots], "sums": [total.tobytes()]})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size)
        for x in group["sums"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"slot": [0], "sums": [total.tobytes()]})

    schema = "slot int, sums binary"
    sums = df.mapInPandas(partial, schema).groupBy("slot").applyInPandas(whole, schema).groupBy("slot").applyInPandas(whole, schema).collect()
    return np.frombuffer(sums[0]["sums"]) if sums else np.zeros(size)


def learnable(labels: DataFrame, mark: str) -> DataFrame:
    """doc_id and y, the mean of its marks, for the ids that may be learnt from."""
    known = labels.where(F.col(mark).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return known.groupBy("doc_id").agg(F.avg(mark).alias("y"))
