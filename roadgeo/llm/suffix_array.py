"""Distributed suffix sorting with a difference cover of three.

Positions that three does not divide are the sample. Their triples of symbols are sorted and named; names that are not
all different are a shorter text, which is sorted in the same way. The ranks of the sample then order the rest: a suffix
that starts at a multiple of three is compared with one of the sample by one or two symbols and a rank. So two plain
sorts, one with each half of the sample, count how many of either half come before it, and that is its place.

A text short enough for BASE is sorted in one task, by doubling; that is the end of the recursion and its size is fixed.
A triple that is very common is one row where it is named, and the key of a plain join after that.

Where only the first symbols of suffixes are compared, their order beyond these decides nothing. Then `equal_neighbours` sorts the
suffixes by their prefixes, dealt out by range, and compares each with those beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgeo.llm.common import discard, shuffle_partitions, staged

#: Symbols that one task sorts at the end of the recursion: a few MB.
BASE = 1 << 18
#: Positions that lie together when symbols are given those after them.
BLOCK = 1 << 12


def counted(df: DataFrame, keys: list[str], flags: list[str], name: str) -> DataFrame:
    """The rows in the order of the keys, which no two rows share, with the number of rows before each that bear a flag: before_<flag>."""
    n = shuffle_partitions(df.sparkSession)
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    names = ["slice", *(f"before_{f}" for f in flags)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "slice int", *(f"{x} bigint" for x in names[1:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far = dict.fromkeys(flags, 0)
        for batch in batches:
            batch["slice"] = TaskContext.get().partitionId()
            for f in flags:
                own = batch[f].to_numpy().astype(np.int64)
                batch[f"before_{f}"] = so_far[f] + np.cumsum(own) - own
                so_far[f] += int(own.sum())
            yield batch

    local = staged(laid.mapInPandas(run, schema), name)
    # A row per partition comes to the driver.
    sums = sorted(local.groupBy("slice").agg(*(F.sum(F.col(f).cast("long")).alias(f) for f in flags)).collect())
    offsets, at = {}, [0] * len(flags)
    for row in sums:
        offsets[row["slice"]] = list(at)
        at = [a + row[f] for a, f in zip(at, flags)]
    if not offsets:
        return local.drop("slice")
    table = df.sparkSession.createDataFrame([(s, *o) for s, o in offsets.items()], "slice int, " + ", ".join(f"_{f} bigint" for f in flags))
    joined = local.join(F.broadcast(table), "slice")  # as many rows as partitions
    out = joined.select(*df.columns, *((F.col(f"before_{f}") + F.col(f"_{f}")).alias(f"before_{f}") for f in flags))
    out.staged_path = local.staged_path
    return out


def ranked(df: DataFrame, keys: list[str], rank: str, name: str) -> DataFrame:
    """The rows with the dense rank, from 1, of their keys."""
    once = df.groupBy(*keys).agg(F.lit(True).alias("one"))
    order = counted(once, keys, ["one"], name)
    out = staged(df.join(order.select(*keys, (F.col("before_one") + 1).alias(rank)), keys), f"{name}-ranked")
    discard(order)
    return out


def _doubled(text: pd.DataFrame) -> pd.DataFrame:
    """Ranks of all suffixes of a short text."""
    text = text.sort_values("i")
    rank = np.unique(text["c"].to_numpy(), return_inverse=True)[1].astype(np.int64) + 1
    n, step = len(rank), 1
    while n and rank.max() < n:
        after = np.append(rank[step:], np.zeros(min(step, n), np.int64))
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return pd.DataFrame({"i": text["i"].to_numpy(), "rank": rank})


def with_following(df: DataFrame, value: str, one: str, two: str) -> DataFrame:
    """The rows, whose i leave no number out, with the values of the next position and of the one after it: 0 beyond the end.

    Blocks of positions come together once; the first two of each go to the block before it too."""
    block, place = F.expr(f"i div {BLOCK}"), F.col("i") % BLOCK
    dealt = df.withColumn("block", F.explode(F.when((place < 2) & (block > 0), F.array(block - 1, block)).otherwise(F.array(block))))
    along = Window.partitionBy("block").orderBy("i")
    after = lambda by, alias: F.coalesce(F.lead(value, by).over(along), F.lit(0)).alias(alias)
    return dealt.select("*", after(1, one), after(2, two)).where(F.col("block") == block).drop("block")


def equal_neighbours(suffixes: DataFrame, slices: int, at_once: int, name: str) -> DataFrame:
    """piece and k of the suffixes (piece, k, prefix) whose prefix is that of a neighbour in the order of prefix, piece and k.

    Suffixes of one prefix may lie in several tasks: the first and the last one of each task are compared on the driver."""
    order = ["prefix", "piece", "k"]
    laid = suffixes.select(*order).repartitionByRange(slices, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        last, shown = None, True

        def end(kind: int, prefix: bytes | None, piece: bytes, k: int) -> pa.RecordBatch:
            x = [here], [kind], [piece], [k], [prefix and xxhash.xxh3_128_digest(prefix)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(x, types)], names=names)

        types, names = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()), ["slice", "kind", "piece", "k", "digest"]
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                prefix, piece, k = part.columns
                row = lambda i: (prefix[i].as_py(), piece[i].as_py(), k[i].as_py())
                if last is None:
                    yield end(1, *row(0))
                before = np.append(last is not None and last[0] == prefix[0].as_py(), pc.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
                if before[0] and not shown:
                    yield end(0, None, *last[1:])
                found = np.flatnonzero(before | np.append(before[1:], False))
                if len(found):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([here] * n, types[0]), pa.array([0] * n, types[1]), piece.take(pa.array(found)), k.take(pa.array(found)), pa.nulls(n, types[4])], names=names)
                last, shown = row(part.num_rows - 1), bool(before[-1])
        if last is not None:
            yield end(2, *last)

    out = staged(laid.mapInArrow(run, "slice int, kind int, piece binary, k int, digest binary"), name)
    # Two rows per task come to the driver.
    ends = sorted(out.where("kind > 0").select("slice", "kind", "digest", "piece", "k").collect())
    more = [(bytes(x.piece), x.k) for a, b in zip(ends[1::2], ends[2::2]) if a.digest == b.digest for x in (a, b)]
    found = out.where("kind = 0").select("piece", "k")
    return found.union(suffixes.sparkSession.createDataFrame(more, "piece binary, k int")) if more else found


def suffix_ranks(text: DataFrame, n: int, base: int = BASE) -> DataFrame:
    """i and rank, from 1, of every suffix of a text (i from 0, symbol c from 1) of n symbols. Shorter suffixes come before their continuations."""
    if n <= base:
        return staged(text.select("i", "c", F.lit(0).alias("all")).groupBy("all").applyInPandas(_doubled, "i bigint, rank bigint"), "suffix-order")
    text = staged(text.select("i", "c"), "suffix-text")

    with_next = with_following(text, "c", "c1", "c2")
    with_next = staged(with_next, "suffix-triples")
    named = ranked(with_next.where("i % 3 <> 0"), ["c", "c1", "c2"], "name", "suffix-names")
    size, names = named.agg(F.count("*"), F.coalesce(F.max("name"), F.lit(0))).first()
    # Positions of the shorter text: first those of remainder 1, then those of remainder 2.
    ones = (n + 1) // 3
    short = named.select(F.expr(f"i div 3 + if(i % 3 = 1, 0, {ones})").alias("k"), "i", F.col("name").alias("c"))
    if names == size:
        sample = staged(short.select("i", F.col("c").alias("rank")), "suffix-ranks")
    else:
        # The end of the first half must not run on into the second one: its last triple then ends in 0 only if n % 3 = 1.
        own = short.select(F.expr(f"k + if(k >= {ones}, 1, 0)").alias("i"), (F.col("c") + 1).alias("c"))
        gap = text.sparkSession.createDataFrame([(ones, 1)], "i bigint, c bigint")
        below = suffix_ranks(own.union(gap), size + 1, base)
        ranks = below.withColumnRenamed("i", "j")
        joined = short.withColumn("j", F.expr(f"k + if(k >= {ones}, 1, 0)")).join(ranks, "j")
        dense = counted(joined.select("i", "rank", F.lit(True).alias("one")), ["rank"], ["one"], "suffix-sample")
        sample = staged(dense.select("i", (F.col("before_one") + 1).alias("rank")), "suffix-ranks")
        discard(below, dense)
    placed = with_next.select("i", "c", "c1").join(sample, "i", "left")
    full = with_following(placed, "rank", "r1", "r2").select("i", "c", "c1", "rank", "r1", "r2", *((F.col("i") % 3 == r).alias(f"is{r}") for r in range(3)))
    full = staged(full, "suffix-full")
    with_ones = counted(full.where("not is2"), ["c", "r1", "i"], ["is0", "is1"], "suffix-merge-1")
    with_twos = counted(full.where("not is1"), ["c", "c1", "r2", "i"], ["is0", "is2"], "suffix-merge-2")
    rest = with_ones.where("is0").select("i", (F.col("before_is0") + F.col("before_is1")).alias("one")).join(
        with_twos.where("is0").select("i", F.col("before_is2").alias("two")), "i").select("i", (F.col("one") + F.col("two") + 1).alias("rank"))
    first = with_ones.where("is1").select("i", (F.col("rank") + F.col("before_is0")).alias("rank"))
    second = with_twos.where("is2").select("i", (F.col("rank") + F.col("before_is0")).alias("rank"))
    out = staged(rest.union(first).union(second), "suffix-order")
    discard(text, with_next, named, sample, full, with_ones, with_twos)
    return out
