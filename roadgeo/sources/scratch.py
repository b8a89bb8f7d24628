"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder, spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own that goes when the process ends; a cluster gets an
    error, since the driver's folder is not the executors'."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/roadgeo-{uuid.uuid4().hex}/{name}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"roadgeo-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"{own}/{name}"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind: else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes intermediate tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
