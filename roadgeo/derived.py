"""OSM-like tables derived from the order tables, by integer arithmetic on whole tables.

Every order is a way, every line item a node of its order's way, every customer a relation of its
orders, every event a track point and a timed run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadgeo.functions import st_point
from roadgeo.operators.numbering import numbered
from roadgeo.types import ELEMENTS, TAGS

NODES_PER_WAY = 64  # room for nodes in a way's id range


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _as_elements(df: DataFrame) -> DataFrame:
    """Fill the absent element columns with NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ELEMENTS.fields
        ]
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per line item; without location where the quantity is 13."""
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    items = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
    )
    located = F.expr(
        """named_struct(
          'longitude', (15900000 + (l_orderkey % 100) * 4000 + (l_partkey % 17) * 200) / 1e6D,
          'latitude', (45800000 + (l_orderkey div 100) * 4000 + (l_suppkey % 13) * 200) / 1e6D)"""
    )
    fits = F.assert_true(F.col("pos") < NODES_PER_WAY, F.lit("too many lines in an order"))
    return _as_elements(
        items.filter(fits.isNull()).select(
            (F.col("l_orderkey") * NODES_PER_WAY + F.col("pos")).alias("id"),
            F.lit("node").alias("kind"),
            F.when(F.coalesce(F.col("l_quantity") != 13, F.lit(True)), located).alias("location"),
        )
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One way per order, with the tags the road queries read."""
    lines = (
        _read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    orders = _read(spark, sf_dir, "orders").join(
        lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    key = F.col("o_orderkey")
    none = F.array().cast("array<bigint>")
    own = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: key * 64 + i)
    extra = (
        F.when(key % 10 == 0, F.array(key * 64))
        .when(key % 7 == 1, F.array((key - 1) * 64))
        .otherwise(none)
    )
    refs = (
        F.when(F.col("n").isNotNull(), F.concat(own, extra))
        .when(key % 2 == 0, none)
        .otherwise(F.lit(None))
    )
    tags = F.expr(
        """map_filter(map(
          'highway', decode(o_orderpriority, '1-URGENT', 'primary', '2-HIGH', 'secondary',
                            '3-MEDIUM', 'tertiary', '4-NOT SPECIFIED', 'residential'),
          'name', if(o_custkey % 5 = 0, null, concat('Road ', o_custkey)),
          'lit', decode(o_orderstatus, 'F', 'yes', 'O', 'no'),
          'surface', decode(o_orderkey % 4, 0, 'asphalt', 1, 'gravel', 2, 'paved'),
          'lanes', decode(o_orderkey % 6, 0, '1', 1, '2', 2, '4', 3, '2;3'),
          'ref', if(o_orderpriority in ('1-URGENT', '2-HIGH'), concat('D', o_custkey), null)
        ), (k, v) -> v is not null)"""
    )
    return _as_elements(
        orders.select(
            key.alias("id"), F.lit("way").alias("kind"), tags.alias("tags"), refs.alias("refs")
        )
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation per customer, of its orders. A relation is one element, so one row, by its format."""
    held = (
        _read(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.sort_array(F.collect_list("o_orderkey")).alias("refs"))
    )
    customers = _read(spark, sf_dir, "customer").join(
        held, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    return _as_elements(
        customers.select(
            F.col("c_custkey").alias("id"),
            F.lit("relation").alias("kind"),
            F.create_map(F.lit("type"), F.lit("route")).cast(TAGS).alias("tags"),
            "refs",
            F.transform(
                "refs", lambda r: F.when(r % 3 == 0, F.lit("node")).otherwise(F.lit("way"))
            ).alias("ref_types"),
        )
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The OSM element table."""
    return (
        nodes(spark, sf_dir).unionByName(ways(spark, sf_dir)).unionByName(relations(spark, sf_dir))
    )


def vehicles(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Track points, one per event; ``keep`` names event columns to keep."""
    return (
        _read(spark, sf_dir, "events")
        .selectExpr(
            "(45800000 + (event_id % 777) * 100) / 1e6D as lat",
            "(15900000 + (event_id % 1000) * 100) / 1e6D as lon",
            "concat('user ', user_id) as track",
            "if(event_id % 11 = 0, null, cast(ts as timestamp)) as time",
            *keep,
        )
        .withColumn("geometry", st_point("lon", "lat"))
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed query runs, one per event, not numbered."""
    return _runs(_read(spark, sf_dir, "events"))


def numbered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed query runs; those of a query are numbered from 0 by time, without gaps."""
    events = numbered(_read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "run")
    return _runs(events, "run")


def _runs(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        F.col("event_type").alias("query"),
        *more,
        F.col("value").alias("execution_time"),
        F.sha2(F.concat_ws("|", "event_type", F.col("user_id") % 3), 256).alias("fingerprint"),
    )
