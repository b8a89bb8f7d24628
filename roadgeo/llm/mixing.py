"""Mixing sources to target weights by Poisson replication.

A source with weight W and n documents repeats each of them W * total / n times on average. How often one document is
repeated is the inverse of the Poisson distribution at a uniform number hashed from the seed and the document's id: no
state, the same on every run, and independent of the partitions. Copies are shuffled globally by another hash.

Rates above STEP are split into equal parts with a number hashed for each, whose counts are summed (a sum of Poisson
variables is one), so that no exponential underflows.

Cases. A null source is a source of its own. A null id hashes as the text 'null'. Rows with one id are repeated equally
often. A null or empty text is a document as any other. A source of weight 0 goes; sources without a given weight get
none. An empty table gives no rows. Other columns are carried, unless they bear the names `copy` and `shuffle_key`,
which are then replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import shuffle_partitions, staged

#: Largest rate that one inversion serves, and the entries of its distribution: beyond them lies less than 2 ** -53.
STEP, ENTRIES = 16.0, 96
SEED = "mix-1"
#: Weight of a source without given weights: its share to this power.
TEMPERATURE = 0.5


def _uniform(*parts) -> F.Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None) -> DataFrame:
    """A row per source: documents, mean repetition rate, parts and the cumulative distribution of one part."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0))
    both = counts.withColumn("w", weight)
    sums = both.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    size = float(sums["n"] or 0) if total is None else float(total)
    scale = size / sums["w"] if sums["w"] else 0.0
    rates = both.select("source", "n", (F.col("w") * F.lit(scale) / F.col("n")).alias("rate"))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int")))
    part = F.col("rate") / F.col("parts")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES)), F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf")),
        lambda acc, k: F.struct((acc["p"] * part / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * part / k)).alias("cdf")),
        lambda acc: acc["cdf"])
    return rates.withColumn("cdf", terms)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """Every document as often as drawn, with `copy` (from 1) and `shuffle_key`; partitions, and rows within them, follow shuffle_key."""
    spark = docs.sparkSession
    # Written, so that Spark knows its size and broadcasts it below its own threshold only.
    rates = staged(source_rates(docs, weights, total), "source-rates").select(F.col("source").alias("_source"), "parts", "cdf")
    # One column holds the document, so that its columns may bear any name.
    picked = docs.drop("copy", "shuffle_key")
    whole = picked.select(F.struct(*(F.col(f"`{c}`") for c in picked.columns)).alias("doc"))
    joined = whole.join(rates, F.col("doc.source").eqNullSafe(F.col("_source")))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0),
        lambda n, j: n + F.size(F.filter("cdf", lambda c: c <= _uniform(F.lit(seed), F.col("doc.doc_id"), j))))
    copies = joined.select("doc", draw.alias("times")).where("times > 0").select("doc.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", _uniform(F.lit(seed + "-order"), F.col("doc_id"), F.col("copy")))
    # The key is uniform, so its range can be cut without sampling.
    n = shuffle_partitions(spark)
    return keyed.repartitionById(n, (F.col("shuffle_key") * n).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy")
