"""Run statistics over a table ``runs(query, run, execution_time, fingerprint)``."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgeo.operators.quantiles import exact_quantiles
from roadgeo.types import geometry_columns


def run_summary(runs: DataFrame) -> DataFrame:
    """``(query, runs, avg_time, min_time, max_time)``."""
    return runs.groupBy("query").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("execution_time").alias("avg_time"),
        F.min("execution_time").alias("min_time"),
        F.max("execution_time").alias("max_time"),
    )


def run_timing(runs: DataFrame) -> DataFrame:
    """One row per run: ``(query, run, execution_time, avg_time, min_time, max_time)``.

    The last three are the query's. A row per run, and no array of them, so that no row grows with
    the number of runs.
    """
    summary = run_summary(runs).drop("runs").withColumnRenamed("query", "_query")
    joined = runs.join(summary, F.col("query").eqNullSafe(F.col("_query")))
    return joined.select("query", "run", "execution_time", "avg_time", "min_time", "max_time")


def run_points(runs: DataFrame) -> DataFrame:
    """One row per query and run, runs numbered from 1: ``(query, run, execution_time)``."""
    return runs.select("query", (F.col("run") + 1).alias("run"), "execution_time")


def run_means(runs: DataFrame) -> DataFrame:
    """Mean time per query, fastest first."""
    return (
        runs.groupBy("query")
        .agg(F.avg("execution_time").alias("avg_time"))
        .orderBy("avg_time", "query")
    )


def run_box_stats(runs: DataFrame) -> DataFrame:
    """Box plot figures per query: quartiles, and whiskers at the furthest times within 1.5 IQR."""
    q = exact_quantiles(runs, "query", "execution_time", [0.25, 0.5, 0.75]).select(
        F.col("query").alias("_query"),
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    time = F.col("execution_time")
    low, high = F.col("q1") - reach, F.col("q3") + reach
    return (
        runs.select("query", "execution_time")
        .join(q, F.col("query").eqNullSafe(F.col("_query")))
        .groupBy("query", "q1", "median", "q3")
        .agg(
            F.min(F.when(time >= low, time)).alias("whisker_low"),
            F.max(F.when(time <= high, time)).alias("whisker_high"),
            F.count_if((time < low) | (time > high)).alias("outliers"),
        )
    )


# ---------------------------------------------------------------- agreement of results


def _comparable(df: DataFrame) -> DataFrame:
    """Without geometry columns, and with maps as sorted entries so that they can be compared."""
    df = df.drop(*geometry_columns(df))
    maps = [f.name for f in df.schema.fields if f.dataType.typeName() == "map"]
    return df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}) if maps else df


def frame_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two results differ, as often as they do, without geometry columns, with ``only_in``.

    Each side is read once: rows count +1 or -1, and equal rows are summed before the shuffle.
    """
    a, b = _comparable(a), _comparable(b)
    names = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*names).withColumn("_n", F.lit(-1)))
    more = both.groupBy(*names).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n")))
    only_in = F.when(F.col("_n") > 0, F.lit("a")).otherwise(F.lit("b"))
    return more.select(*names, only_in.alias("only_in"), times.alias("_n")).drop("_n")


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*df.columns).cast("decimal(38,0)")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, fingerprint)`` that does not depend on row order."""
    df = _comparable(df)
    total = F.coalesce(F.sum(_row_hash(df)), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("total")).select(
        "n_rows",
        F.sha2(F.concat_ws("|", F.col("n_rows"), F.col("total").cast("string")), 256).alias(
            "fingerprint"
        ),
    )


def run_agreement(runs: DataFrame) -> DataFrame:
    """Do all runs of a query have the same fingerprint? ``(query, runs, agree)``.

    Least and greatest fingerprint suffice, so no set of values is gathered.
    """
    print_ = F.col("fingerprint")
    return runs.groupBy("query").agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.min(print_) == F.max(print_), F.lit(False)).alias("agree"),
    )


# ---------------------------------------------------------------- one query, many parameters


def parameter_sweep(
    df: DataFrame, params: Sequence[Mapping], fn: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``fn`` for every parameter set in one job.

    ``fn`` gets ``df`` with a struct column ``param``, each row once per parameter set, and has to
    keep ``param`` apart (group by it). The table is scanned once for all values.
    """
    names = list(params[0])
    values = [F.struct(*[F.lit(p[n]).alias(n) for n in names]) for p in params]
    return fn(df.withColumn("param", F.explode(F.array(*values))))


def sql_sweep(spark: SparkSession, text: str, params: Sequence[Mapping]) -> DataFrame:
    """One query text with named markers (``:name``), run for each parameter set.

    Each result row carries its parameters as columns. The sets form a table that the text is joined to as a lateral
    subquery, with its markers as columns of that table: one plan, and one scan for all sets. Spark cannot join every text
    that way (one with a limit, or a marker inside an outer join, say); for such a text each set is a query of its own.
    """
    names = list(params[0])
    sets = spark.createDataFrame([tuple(p[n] for n in names) for p in params], names)
    sets.createOrReplaceTempView("sweep_sets")
    # string literals and casts with a double colon are passed over
    marked = re.sub(r"'(?:[^']|'')*'|::|:([A-Za-z_]\w*)", lambda m: f"sweep_sets.`{m[1]}`" if m[1] else m[0], text)
    listed = ", ".join(f"sweep_sets.`{n}`" for n in names)
    try:
        return spark.sql(f"SELECT found.*, {listed} FROM sweep_sets, LATERAL ({marked}) AS found")
    except AnalysisException:
        results = [spark.sql(text, args=dict(p)).withColumns({n: F.lit(v) for n, v in p.items()}) for p in params]
        return reduce(DataFrame.unionByName, results)
