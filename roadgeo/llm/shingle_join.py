"""Jaccard self join on word shingles with signature trees, and the components of its links.

Two sets of a and b elements whose intersection is t hundredths of the union differ in (a + b) (100 - t) / (100 + t)
elements, one nineteenth of a + b for 90.
So when the hash space is cut into one part more than that, at least one part of both holds the same elements. Texts
with the same set are one class. A class has a fingerprint for every part of the tables of its size: these are its keys.
Of two linked classes each has no more keys that the other lacks than elements may differ. So the rarest key that they share is
among the first of each, in order of how many classes have a key, as soon as one more of them is taken than may differ.
Only these bring classes together in a bucket, and keys that one class alone has come first of all. This places pairs without
losing one, and a frequent passage makes a bucket only of classes that have too few rarer keys.

In a bucket, first every class is compared with the smallest one: that is linear, and joins most copies. What is left
are buckets whose classes are not all connected. There, signature trees are joined: leaves hold the classes' token
bitmaps and sizes, inner nodes the bitmaps (folded) combined by OR (and by AND) and the range of sizes. A bit tells whether
an odd number of elements fall on it, so what two sets share leaves no trace in the bits in which they differ, and these are
never more than the elements in which they differ. A pair of nodes is
entered only if the least difference that bitmaps and sizes allow is within the threshold. Buckets of more than CHUNK
classes are cut into chunks, and each pair of chunks is a task's work. A pair that is connected already is not given. Of buckets of one table that hold the same classes, one stands for all.
Every candidate is then decided on its whole shingle sets.

The result has a row per document: its set's size and its component. Links themselves are not expanded.

Cases. A null or empty text has no shingles and is its own component; so is a document without a partner. Fewer words
than a shingle has make one shingle of all. Rows with one id are one document, whose texts all link it. Null ids have a
null component. Columns other than `doc_id` and `text` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgeo.llm.common import by_batch, discard, staged
from roadgeo.llm.components import components

#: Words of a shingle, and the intersection in hundredths of the union from which on two sets are linked.
WORDS, OF_UNION = 3, 90
CHUNK, LEAF, FANOUT = 2048, 16, 8
#: Shares of buckets and of pairs that are handled one after the other: the shuffle of one is gone before the next.
SHARES = 4
#: Bits of a part's place, below the 7 of its table.
PLACE = 25
#: Bitmaps are kept so many times shorter, at a bit or more per element: a class has one in each of its buckets.
FOLDED = 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z, splits at the six white bytes
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    with np.errstate(over="ignore"):
        n = max(1, len(h) - words + 1)
        out = np.full(n, np.uint64(min(len(h), words)))
        for k in range(min(words, len(h))):
            out = (out ^ h[k : k + n]) * _MIX[k % 3]
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _edges() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, edges[-1] * 5 // 4))
    return edges


#: Sizes from which on sets lie in the next table.
EDGES = _edges()
_PARTS: dict[tuple[int, int], int] = {}


def differences(table: int, of_union: int) -> int:
    """Elements in which two sets of a table may differ: its sizes lie below the next edge."""
    return (100 - of_union) * 2 * (EDGES[table + 1] - 1) // (100 + of_union)


def allowed(n: int, table: int, of_union: int) -> int:
    """Elements in which a set of n may differ from another one of a table: that has at most 100 n / of_union."""
    return min(differences(table, of_union), n * (100 - of_union) // of_union)


def n_parts(table: int, of_union: int) -> int:
    """So many that even a set of the smallest size hardly ever has fewer parts with elements than one more than may differ, where that is possible."""
    if (found := _PARTS.get((table, of_union))) is None:
        k, least = differences(table, of_union), -(-of_union * EDGES[table] // 100)
        found = k + 2 + k // 40
        for m in range(k + 2, 2 * k + 8, 1 + k // 50):
            full, share = least / m, math.exp(-least / m)
            if m * (1 - share) - 3 * math.sqrt(m * share * (1 - (1 + full) * share)) > k:
                found = m
                break
        _PARTS[table, of_union] = found
    return found


def fingerprints(h: np.ndarray, table: int, of_union: int = OF_UNION) -> tuple[np.ndarray, int]:
    """A 32-bit number for each part of the hash space, 0 for an empty part, and how many of the others, the most frequent ones, are not needed as keys.

    A set with so few parts that all agreement could lie in empty ones has these as keys too, as -1, and needs all."""
    m = n_parts(table, of_union)
    edges = (np.arange(m, dtype=np.uint64) * np.uint64((1 << 64) // m)).astype(np.uint64)
    starts = np.searchsorted(h, edges)
    sizes = np.diff(np.append(starts, len(h)))
    with np.errstate(over="ignore"):
        mixed = (h ^ (h >> np.uint64(31))) * _MIX[1]
        sums = np.add.reduceat(np.append(mixed, np.uint64(0)), starts)
    out = (sums >> np.uint64(32)).astype(np.int64).astype(np.int32)
    out[out == 0] = 1
    out[sizes == 0] = 0
    surplus = int((sizes > 0).sum()) - allowed(len(h), table, of_union) - 1
    if surplus < 0:
        out[sizes == 0] = -1
    return out, max(0, surplus)


def tables_of(n: int, of_union: int = OF_UNION) -> list[int]:
    """Tables by size: a set's own, and the next ones if a partner may lie in them. Sets that allow no difference have none."""
    own, last = (bisect_right(EDGES, x) - 1 for x in (n, 100 * n // of_union))
    return [t for t in range(own, last + 1) if differences(t, of_union)]


_SETS = "doc_id bigint, n_shingles bigint, set_key binary, bits binary, tables array<struct<size:int,surplus:int,parts:array<int>>>"


def _described(words: int, of_union: int):
    def rows(ids, texts):
        for doc_id, text in zip(ids, texts):
            h = shingles(text, words)
            key = hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None
            tables = []
            for t in tables_of(len(h), of_union) if len(h) else ():
                parts, surplus = fingerprints(h, t, of_union)
                tables.append({"size": t, "surplus": surplus, "parts": parts.tolist()})
            yield doc_id, len(h), key, folded(bitmap(h)) if tables else None, tables

    return rows


def _sets_of(words: int):
    return lambda ids, texts: ((i, shingles(t, words).view(np.int64).tolist()) for i, t in zip(ids, texts))


def _likely(of_union: int):
    def rows(a, b, n_a, n_b, bits_a, bits_b):
        """Pairs whose bitmaps allow the threshold."""
        for x, y, n, m, u, v in zip(a, b, n_a, n_b, bits_a, bits_b):
            maps = same_length([u, v])
            apart = max(int(np.bitwise_count(maps[0] ^ maps[1]).sum(dtype=np.int64)), abs(n - m))
            if (100 + of_union) * apart <= (100 - of_union) * (n + m):
                yield x, y

    return rows


def bitmap(h: np.ndarray) -> bytes:
    """Whether an odd number of elements fall on each of four to ten times as many bits: of sets that may meet in a table, none has fewer than four for each element of another."""
    size = min(1 << max(6, int(2.5 * len(h)).bit_length() + 1), 1 << 15)
    at = (h >> np.uint64(17)) & np.uint64(size - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def folded(bits: bytes) -> bytes:
    """A bitmap's parts on top of each other: bits that differ here differ in the whole."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, max(8, len(bits) // FOLDED)), axis=0).tobytes()


def same_length(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the shortest length, as rows of 64-bit words."""
    least = min(map(len, maps))
    rows = [np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0) for m in maps]
    return np.stack(rows).view(np.uint64) if least % 8 == 0 else np.stack(rows)


class Tree:
    """Levels of nodes over classes in their order, leaves first: bitmaps by OR and AND, sizes and components from and to."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        self.rows = (maps, maps, sizes, sizes, component, component)
        self.levels = [self._above(self.rows, LEAF)]
        while len(self.levels[-1][2]) > 1:
            self.levels.append(self._above(self.levels[-1], FANOUT))

    @staticmethod
    def _above(nodes: tuple[np.ndarray, ...], fanout: int) -> tuple[np.ndarray, ...]:
        starts = np.arange(0, len(nodes[2]), fanout)
        combine = (np.bitwise_or, np.bitwise_and, np.minimum, np.maximum, np.minimum, np.maximum)
        return tuple(f.reduceat(x, starts) for f, x in zip(combine, nodes))


def _missing(every: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Bits of the one that the other lacks."""
    return np.bitwise_count(every & ~some).sum(axis=-1, dtype=np.int64)


def _possible(x, i, y, j, of_union: int) -> np.ndarray:
    """Whether pairs of nodes may hold a pair of sets that reaches the threshold and is not connected; bitmaps are compared where sizes and components allow one."""
    ok = (100 + of_union) * np.minimum(x[3][i], y[3][j]) >= of_union * (x[2][i] + y[2][j])
    ok &= (x[4][i] != y[5][j]) | (x[5][i] != y[4][j])
    open_ = np.flatnonzero(ok)
    i, j = i[open_], j[open_]
    apart = _missing(x[1][i], y[0][j]) + _missing(y[1][j], x[0][i])
    ok[open_] = (100 + of_union) * apart <= (100 - of_union) * (x[3][i] + y[3][j])
    return ok


def joined(a: Tree, b: Tree, once: bool, of_union: int = OF_UNION) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two components whose bitmaps and sizes allow the threshold, by the traversal of both trees. once: the two are one, and each pair is given once."""
    p, q = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, int), np.zeros(1, int)

    def below(nodes: np.ndarray, partner: np.ndarray, fanout: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        wide = (nodes[:, None] * fanout + np.arange(fanout)).ravel()
        there = wide < count
        return wide[there], np.repeat(partner, fanout)[there]

    while p or q:
        ok = _possible(a.levels[p], i, b.levels[q], j, of_union)
        i, j = i[ok], j[ok]
        if p >= q and p:
            p -= 1
            i, j = below(i, j, FANOUT, len(a.levels[p][2]))
        else:
            q -= 1
            j, i = below(j, i, FANOUT, len(b.levels[q][2]))
        if once and p == q:
            i, j = i[i <= j], j[i <= j]
    ok = _possible(a.levels[0], i, b.levels[0], j, of_union)
    i, j = i[ok], j[ok]
    found = []
    n, m = len(a.rows[2]), len(b.rows[2])
    for start in range(0, len(i), 256):
        x, y = below(i[start : start + 256], j[start : start + 256], LEAF, n)
        y, x = below(y, x, LEAF, m)
        if once:
            x, y = x[x < y], y[x < y]
        ok = _possible(a.rows, x, b.rows, y, of_union)
        found.append((x[ok], y[ok]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(f) for f in zip(*found))


def _tree_join(cell: dict[str, np.ndarray], of_union: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one bucket's pair of chunks that are not connected yet."""
    if (cell["component"] == cell["component"][0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Large components lie together, so that their nodes need no comparison among themselves.
    _, own, counts = np.unique(cell["component"], return_inverse=True, return_counts=True)
    order = np.lexsort((cell["rep"], cell["n"], np.where(counts[own] >= LEAF, own, -1)))
    cell = {k: v[order] for k, v in cell.items()}
    maps, sizes, comp, rep = same_length(cell["bits"].tolist()), cell["n"], cell["component"], cell["rep"]
    left, right = cell["left"][0], cell["right"][0]
    if left == right:
        tree = Tree(maps, sizes, comp)
        i, j = joined(tree, tree, True, of_union)
    else:
        x, y = np.flatnonzero(cell["chunk"] == left), np.flatnonzero(cell["chunk"] == right)
        if not len(x) or not len(y):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = joined(Tree(maps[x], sizes[x], comp[x]), Tree(maps[y], sizes[y], comp[y]), False, of_union)
        i, j = x[i], y[j]
    a, b = rep[i], rep[j]
    return np.maximum(a, b), np.minimum(a, b)


def _cell_by_cell(of_union: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Joins each cell of a partition, whose rows come cell by cell; the last cell of a batch may go on in the next."""
        rest = None
        for batch in chain(batches, [None]):
            rows = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows is None or not len(rows):
                continue
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            same = np.logical_and.reduce([columns[c][1:] == columns[c][:-1] for c in ("key", "left", "right")])
            ends = np.append(np.flatnonzero(~same) + 1, [len(rows)] * (batch is None)).astype(int).tolist()
            found, start = [(np.zeros(0, np.int64),) * 2], 0
            for end in ends:
                if end - start > 1:
                    found.append(_tree_join({c: v[start:end] for c, v in columns.items()}, of_union))
                start = end
            rest = rows.iloc[start:]
            a, b = (np.concatenate(f) for f in zip(*found))
            yield pd.DataFrame({"a": a, "b": b})

    return run


def in_shares(pairs: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """run() over stored pairs (a, b), a share of them at a time."""
    share = F.pmod(F.xxhash64("a", "b"), F.lit(SHARES))
    done = [staged(run(pairs.where(share == k)), name) for k in range(SHARES)]
    whole = staged(reduce(DataFrame.union, done), name)
    discard(*done)
    return whole


def likely(pairs: DataFrame, signatures: DataFrame, of_union: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose bitmaps and sizes allow the threshold: these are small beside the sets."""
    of = lambda c: signatures.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))

    def compared(share: DataFrame) -> DataFrame:
        both = share.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        return by_batch(both, _likely(of_union), "a bigint, b bigint")

    return in_shares(pairs, compared, "shingle-likely")


def verified(pairs: DataFrame, texts: DataFrame, words: int, of_union: int = OF_UNION) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole sets reach the threshold."""
    asked = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    sets = by_batch(texts.join(asked, texts["doc_id"] == asked["rep"], "left_semi"), _sets_of(words), "rep bigint, hashes array<bigint>")
    sets = staged(sets, "shingle-hashes")
    of = lambda c: sets.select(F.col("rep").alias(c), F.col("hashes").alias(f"of_{c}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    reach = (100 + of_union) * common >= of_union * (F.size("of_a") + F.size("of_b"))
    links = in_shares(pairs, lambda share: share.join(of("a"), "a").join(of("b"), "b").where(reach).select("a", "b").distinct(), "shingle-links")
    discard(sets)
    return links


def link(docs: DataFrame, words: int = WORDS, of_union: int = OF_UNION) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    texts = docs.select("doc_id", "text")
    wide = staged(by_batch(texts, _described(words, of_union), _SETS), "shingle-tables")
    described = staged(wide.select("doc_id", "n_shingles", "set_key"), "shingle-sets")
    of_key = wide.where("doc_id is not null and set_key is not null").groupBy("set_key")
    full = staged(of_key.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("tables").alias("tables")), "shingle-classes")
    discard(wide)

    # size, n and place make one number: few bytes are shuffled for each part.
    sizes = F.shiftleft(F.col("n"), 32).bitwiseOR(F.shiftleft(F.col("size").cast("bigint"), PLACE)).bitwiseOR(F.col("place").cast("bigint"))
    keyed = full.select("rep", "n", F.hash("set_key").alias("own"), F.inline("tables")).select("rep", "n", "own", "size", "surplus", F.posexplode("parts").alias("place", "part")).where("part <> 0")
    keyed = keyed.select(F.xxhash64("size", "place", "part").alias("key"), "rep", "own", sizes.alias("sizes"), "surplus")
    prefixes = _prefixes(keyed)
    shares = [_buckets(prefixes.where(F.pmod("key", F.lit(SHARES)) == share)) for share in range(SHARES)]
    discard(prefixes)
    members = reduce(DataFrame.union, shares)

    signatures = staged(full.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "bits"), "shingle-signatures")
    classes = staged(full.select("set_key", "rep"), "shingle-classes")
    discard(full)

    fits = 100 * F.least("n", "first.n") >= of_union * F.greatest("n", "first.n")
    stars = members.where((F.col("rep") != F.col("first.rep")) & fits).select(F.col("rep").alias("a"), F.col("first.rep").alias("b")).distinct()
    stars = staged(stars, "shingle-star-pairs")
    close = likely(stars, signatures, of_union)
    # Rows of one id that have different sets are one document.
    known = described.where("doc_id is not null and set_key is not null")
    same = known.select("doc_id", "set_key").distinct().join(classes, "set_key").groupBy("doc_id").agg(
        F.min("rep").alias("b"), F.collect_set("rep").alias("reps")).where("size(reps) > 1").select(F.explode("reps").alias("a"), "b").where("a <> b")
    links = verified(close, texts, words, of_union)
    connected = components(links.union(same))
    discard(stars, close, links)

    pairs = []
    for share in shares:
        pairs.append(staged(_tree_pairs(share, signatures, connected, of_union), "shingle-tree-pairs"))
        discard(share)
    different = staged(reduce(DataFrame.union, pairs).distinct(), "shingle-tree-pairs")
    rest = verified(different, texts, words, of_union)
    discard(signatures, different, *pairs)
    if not rest.isEmpty():
        connected = components(connected.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))
    placed = classes.join(connected.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = described.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _several(keyed: DataFrame) -> DataFrame:
    """The rows of keys that several classes have, and of how many."""
    met = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return keyed.join(met, "key")


def _prefixes(keyed: DataFrame) -> DataFrame:
    """The keys of a class and table that several classes have, without its most frequent ones that are not needed."""
    of_key, of_rep = F.pmod("key", F.lit(SHARES)), F.pmod(F.xxhash64("rep"), F.lit(SHARES))
    stored = [staged(_several(keyed.where(of_key == share)), "shingle-keys") for share in range(SHARES)]
    ranked = reduce(DataFrame.union, stored).withColumn("size", F.shiftright("sizes", PLACE))
    frequent = F.row_number().over(Window.partitionBy("rep", "size").orderBy(F.desc("members"), F.desc("key")))
    kept = [ranked.where(of_rep == share).withColumn("frequent", frequent).where("frequent > surplus") for share in range(SHARES)]
    kept = [staged(k.select("key", "rep", "own", "sizes"), "shingle-prefixes") for k in kept]
    whole = staged(reduce(DataFrame.union, kept), "shingle-prefixes")
    discard(*stored, *kept)
    return whole


def _buckets(keyed: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several classes, and the smallest class of each.

    Copies that differ little agree in most parts, so many buckets of a table hold the same classes and give the same pairs.
    The one of the first place stands for them all."""
    stored = staged(_several(keyed), "shingle-buckets")
    n, table, place = F.shiftright("sizes", 32), F.shiftright("sizes", PLACE).bitwiseAND(F.lit(127)), F.col("sizes").bitwiseAND(F.lit((1 << PLACE) - 1))
    rows = stored.select("key", "rep", "own", "members", n.alias("n"), table.cast("int").alias("size"), place.cast("int").alias("place"))
    low = F.xxhash64("rep").bitwiseAND(F.lit((1 << 32) - 1))
    buckets = rows.groupBy("key", "members", "size", "place").agg(F.min(F.struct("rep", "n")).alias("first"), F.sum(F.col("own").cast("bigint")).alias("owns"), F.sum(low).alias("reps"))
    stand = buckets.groupBy("size", "members", "first", "owns", "reps").agg(F.min(F.struct("place", "key")).alias("by")).select("by.key", "first")
    found = staged(rows.drop("own").join(stand, "key"), "shingle-members")
    discard(stored)
    return found


def _tree_pairs(members: DataFrame, sets: DataFrame, connected: DataFrame, of_union: int) -> DataFrame:
    """Candidates, not connected yet, of the buckets that hold several components."""
    rows = members.join(connected.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    split = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = rows.join(split, "key")
    full = open_.join(sets, ["rep", "n"])
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    dealt = full.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks).cast("int"))
    # A row of chunk c goes to the cells (i, c) with i <= c and (c, j) with j > c.
    cells = F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: F.struct(F.least(i, F.col("chunk")).alias("left"), F.greatest(i, F.col("chunk")).alias("right")))
    dealt = dealt.select("key", "rep", "component", "n", "bits", "chunk", F.inline(cells))
    cell = ["key", "left", "right"]
    laid = dealt.repartition(*cell).sortWithinPartitions(*cell)
    return laid.mapInPandas(_cell_by_cell(of_union), "a bigint, b bigint").distinct()
