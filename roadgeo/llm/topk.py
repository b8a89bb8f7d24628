"""Exact top-k by inner product, block at a time.

Vectors become whole numbers. Each component is two terms, its positive and its negative part, so that a block's largest
and smallest values of a component are its term maxima, and a query's sum of products with them bounds every score in
the block. Rows are laid out along a curve of similar vectors and cut into ranges of about RANGE rows, and these into
blocks of BLOCK rows with a forward index: ids and components.

The queries of a range form a chunk. A chunk is first scored within its own range, where similar vectors lie, which
gives each query a floor under its k-th score. Then each pair of chunk and range is one task's work: blocks are taken in
the order of their bounds for each query and scored until the bounds fall below the k-th score. The best k of each
pair meet in a window that keeps k rows of each query before the shuffle.

Cases. A vector that is null, or holds a null or a component that is not finite, takes no part, nor does a null id.
Shorter vectors count as filled up with zeros. A row with the query's id is not a candidate; a query id that occurs
twice is asked twice. Ties go to the smaller id. Fewer than k candidates give all of them. Empty tables give no rows.
Columns other than `vec_id` and `embedding` are not read. Components of 2**46 and more, and components so large that scores
could leave the range of exact whole numbers, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgeo.llm.common import staged

K, EVERY, SCALE = 20, 20, 64.0
RANGE, BLOCK = 8192, 256
#: Random directions whose signs, as a Gray code, place a vector on the curve.
DIRECTIONS, SEED = 12, 7
LOWEST = -(1 << 62)
#: Components below this become whole numbers exactly.
LARGEST = float(1 << 46)

_BLOCKS = "range_id int, n int, dims int, ids binary, parts binary"
_CHUNKS = "chunk_id int, dims int, ids binary, parts binary, floors binary"
_BEST = "query_id bigint, query_row bigint, vec_id bigint, score bigint"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the components in whole numbers, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    large = F.raise_error(F.lit(f"a component of {LARGEST:.0f} or more has no exact score")).cast("bigint")
    whole = lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("bigint")
    parts = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < LARGEST, whole(x)).otherwise(large))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", parts.alias("parts"))


def _matrix(rows) -> np.ndarray:
    dims = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds each vector's place on the curve."""
    for batch in batches:
        m = _matrix(batch["parts"].tolist())
        signs = (m @ np.random.default_rng(SEED).normal(size=(DIRECTIONS, 1 << 12))[:, : m.shape[1]].T > 0) if m.shape[1] <= 1 << 12 else np.zeros((len(m), DIRECTIONS), bool)
        order = np.cumsum(signs, axis=1) % 2  # from Gray code
        yield batch.assign(place=(order @ (1 << np.arange(DIRECTIONS)[::-1])).astype(np.int32))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of a partition's rows, which come in the order of the curve."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch])
        while len(rest) >= BLOCK:
            yield _block(rest.iloc[:BLOCK])
            rest = rest.iloc[BLOCK:]
    if rest is not None and len(rest):
        yield _block(rest)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    m = _matrix(rows["parts"].tolist())
    return pd.DataFrame({"range_id": [TaskContext.get().partitionId()], "n": [len(rows)], "dims": [m.shape[1]], "ids": [rows["vec_id"].to_numpy().astype(np.int64).tobytes()], "parts": [m.tobytes()]})


class Range:
    """The blocks of a range: forward indexes and term maxima."""

    def __init__(self, blocks: pd.DataFrame, dims: int):
        self.blocks, self.ids = [], []
        for n, own, ids, parts in zip(blocks["n"], blocks["dims"], blocks["ids"], blocks["parts"]):
            m = np.zeros((n, dims), np.int64)
            m[:, :own] = np.frombuffer(parts, np.int64).reshape(n, own)
            self.blocks.append(m)
            self.ids.append(np.frombuffer(ids, np.int64))
        self.high = np.stack([m.max(0) for m in self.blocks])
        self.low = np.stack([m.min(0) for m in self.blocks])
        every = np.concatenate(self.ids)
        self.sorted = np.sort(every)
        self.shift = int(len(every)).bit_length()
        ranks = np.argsort(np.argsort(every, kind="stable"), kind="stable")
        #: Larger for smaller ids, so that a score and this make one number to be compared.
        self.favour = np.split(len(every) - 1 - ranks, np.cumsum([len(x) for x in self.ids])[:-1])


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed: in floating point where all sums are exact, else in whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def best_of_range(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, part: Range, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best k in a range, as far as they reach its floor; LOWEST where there are fewer."""
    widest = max(int(part.high.max(initial=0)), -int(part.low.min(initial=0))) * int(np.abs(queries).max(initial=0)) * queries.shape[1]
    if widest << part.shift >= 1 << 62:
        raise ValueError(f"scores of up to {widest} are too large to be compared exactly")
    bounds = _products(np.maximum(queries, 0), part.high) + _products(np.minimum(queries, 0), part.low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), LOWEST)  # score << shift | favour
    floors = floors.copy()
    asking = np.arange(len(queries))
    for turn in range(len(part.blocks)):
        block = order[asking, turn]
        go_on = bounds[asking, block] >= floors[asking]  # a tie may still bring a smaller id
        asking, block = asking[go_on], block[go_on]
        if not len(asking):
            break
        by_block = np.argsort(block, kind="stable")
        for group in np.split(asking[by_block], np.flatnonzero(np.diff(block[by_block])) + 1):
            b = order[group[0], turn]
            scores = _products(queries[group], part.blocks[b])
            key = scores << part.shift | part.favour[b]
            key[part.ids[b][None, :] == query_ids[group][:, None]] = LOWEST
            both = np.hstack([best[group], key])
            best[group] = -np.partition(-both, k - 1, axis=1)[:, :k]
            kth = best[group].min(axis=1)
            floors[group] = np.maximum(floors[group], np.where(kth > LOWEST, kth >> part.shift, LOWEST))
    found = best > LOWEST
    ids = part.sorted[np.where(found, len(part.sorted) - 1 - (best & ((1 << part.shift) - 1)), 0)]
    return np.where(found, best >> part.shift, LOWEST), ids


def _own_range(k: int, every: int):
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        """A range's queries as a chunk, with the floors that the range itself gives."""
        dims = int(blocks["dims"].max())
        part = Range(blocks.sort_values("ids"), dims)
        ids, parts = np.concatenate(part.ids), np.concatenate(part.blocks)
        asks = ids % every == 0
        if not asks.any():
            return pd.DataFrame({c.split()[0]: [] for c in _CHUNKS.split(", ")})
        q, qi = parts[asks], ids[asks]
        scores, _ = best_of_range(q, qi, np.full(len(q), LOWEST), part, k)
        return pd.DataFrame({"chunk_id": [int(blocks["range_id"].iloc[0])], "dims": [dims], "ids": [qi.tobytes()], "parts": [q.tobytes()], "floors": [scores.min(axis=1).tobytes()]})

    return run


def _pair(k: int):
    def run(chunks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        """Best k of one chunk's queries in one range."""
        if not len(chunks) or not len(blocks):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in _BEST.split(", ")})
        dims = max(int(chunks["dims"].max()), int(blocks["dims"].max()))
        chunk = chunks.iloc[0]
        ids = np.frombuffer(chunk["ids"], np.int64)
        q = np.zeros((len(ids), dims), np.int64)
        q[:, : chunk["dims"]] = np.frombuffer(chunk["parts"], np.int64).reshape(len(ids), chunk["dims"])
        scores, found = best_of_range(q, ids, np.frombuffer(chunk["floors"], np.int64), Range(blocks, dims), k)
        row, col = np.nonzero(scores > LOWEST)
        return pd.DataFrame({"query_id": ids[row], "query_row": (int(chunk["chunk_id"]) << 32) + row, "vec_id": found[row, col], "score": scores[row, col]})

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the best k rows for each row whose id `every` divides."""
    rows = whole_vectors(vectors)
    ranges = max(1, -(-rows.count() // RANGE))
    placed = rows.mapInPandas(_placed, "vec_id bigint, parts array<bigint>, place int")
    laid = placed.repartitionByRange(ranges, "place", "vec_id").sortWithinPartitions("place", "vec_id")
    blocks = staged(laid.mapInPandas(_packed, _BLOCKS), "topk-blocks")
    chunks = staged(blocks.groupBy("range_id").applyInPandas(_own_range(k, every), _CHUNKS), "topk-chunks")
    # Every chunk meets every range: the chunks' ids, one per RANGE rows, are listed and the pairs are keys.
    range_ids = [r[0] for r in blocks.select("range_id").distinct().collect()]
    chunk_ids = [r[0] for r in chunks.select("chunk_id").collect()]
    listed = lambda ids: F.explode(F.array(*map(F.lit, ids)).cast("array<int>"))
    left = chunks.withColumn("range_id", listed(range_ids)).groupBy("chunk_id", "range_id")
    right = blocks.withColumn("chunk_id", listed(chunk_ids)).groupBy("chunk_id", "range_id")
    best = left.cogroup(right).applyInPandas(_pair(k), _BEST)
    ranked = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
