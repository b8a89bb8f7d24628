"""Exact quantiles per group without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000  # rank error of the sketch is below n / ACCURACY


def exact_quantiles(
    df: DataFrame, group: str, value: str, probabilities: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Exact quantiles, linear between neighbours: ``(group, n, quantiles ARRAY<DOUBLE>)``.

    A sketch of bounded size brackets each quantile from both sides. The rows below a bracket are
    only counted; the rows inside, about ``4 n / accuracy`` of them, are reduced to counts per
    distinct value, and the wanted ranks are picked among those. If a bracket ever failed to hold
    its rank, the job would stop instead of giving a wrong number.
    """
    df = df.select(F.col(group).alias("own"), F.col(value).cast("double").alias("v"))
    df = df.filter(F.col("v").isNotNull())
    slack = 2.0 / accuracy
    cuts = [p + s for p in probabilities for s in (-slack, slack)]
    cuts = [min(max(c, 0.0), 1.0) for c in cuts]
    marks = df.groupBy("own").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        F.percentile_approx("v", cuts, accuracy).alias("m"),
    )
    # in a small group the slack is less than one rank; its bracket holds all of it
    small = F.col("n") <= 10 * accuracy
    brackets = marks.select(
        F.col("own").alias("g"),
        "n",
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("i"),
                    ((F.col("n") - 1) * F.lit(float(p))).alias("at"),
                    F.when(small | F.lit(cuts[2 * i] <= 0.0), F.col("least"))
                    .otherwise(F.col("m")[2 * i])
                    .alias("lo"),
                    F.when(small | F.lit(cuts[2 * i + 1] >= 1.0), F.col("most"))
                    .otherwise(F.col("m")[2 * i + 1])
                    .alias("hi"),
                )
                for i, p in enumerate(probabilities)
            ]
        ).alias("brackets"),
    )
    # each row is below (-1), inside (0) or above (1) each bracket; only those inside keep a value
    side = (
        F.when(F.col("v") < F.col("b.lo"), -1).when(F.col("v") > F.col("b.hi"), 1).otherwise(0)
    )
    spread = (
        df.join(brackets, F.col("own").eqNullSafe(F.col("g")))
        .select("g", "n", F.explode("brackets").alias("b"), "v")
        .select("g", "n", "b.i", "b.at", side.alias("side"), "v")
        .withColumn("v", F.when(F.col("side") == 0, F.col("v")))
        .groupBy("g", "n", "i", "at", "side", "v")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    order = W.partitionBy("g", "i").orderBy("side", "v")
    ranked = spread.withColumn("upto", F.sum("times").over(order))
    low, high = F.floor("at"), F.ceil("at")

    def holds(rank):
        return (F.col("upto") > rank) & (F.col("upto") - F.col("times") <= rank)

    picked = ranked.groupBy("g", "n", "i", "at").agg(
        F.max(F.when(holds(low), F.col("v"))).alias("v_low"),
        F.max(F.when(holds(high), F.col("v"))).alias("v_high"),
    )
    found = F.assert_true(
        F.col("v_low").isNotNull() & F.col("v_high").isNotNull(),
        F.lit("a quantile lies outside its bracket"),
    ).isNull()
    part = F.col("at") - F.floor("at")
    exact = picked.filter(found).withColumn(
        "q", F.col("v_low") + (F.col("v_high") - F.col("v_low")) * part
    )
    return (
        exact.groupBy("g", "n")
        .agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("q"))
        .select(F.col("g").alias(group), "n", F.transform("q", lambda s: s["q"]).alias("quantiles"))
    )
