"""Row numbers without gaps, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadgeo.sources.scratch import scratch_path


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows with their number in ``group``, from 0 in the order given, as column ``name``.

    Rows are cut into ranges of (group, order), so that a group of any size lies in many of them,
    and stored. A window numbers the rows of each range; the counts of the ranges before it, a row
    per range and group, are added. ``order`` tells the rows of a group apart.
    """
    path = scratch_path(df.sparkSession, "numbered")
    laid = df.repartitionByRange(group, *order).withColumn("_slice", F.spark_partition_id())
    laid.write.parquet(path)
    stored = df.sparkSession.read.schema(laid.schema).parquet(path)
    own = W.partitionBy("_slice", group).orderBy(*order)
    earlier = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    counts = stored.groupBy("_slice", group).count()
    before = counts.select(
        F.col("_slice").alias("_s"),
        F.col(group).alias("_g"),
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"),
    )
    local = stored.withColumn("_n", F.row_number().over(own))
    joined = local.join(before, (F.col("_slice") == F.col("_s")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_n") - 1).alias(name))
