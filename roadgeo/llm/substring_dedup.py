"""Removal of byte strings that repeat anywhere in the corpus, by suffix sorting.

Sorting every byte's suffix takes rows many times the text. So texts are cut first where their content says so: each
window of 200 bytes belongs to an anchor (see `anchors`), equal windows to equal anchors. The bytes from one anchor to the
end of the next one's k-gram are a phrase. A phrase that occurs once ends every repeat; what remains are pieces, sequences of
phrases that occur again. Equal pieces are one. The different pieces are texts whose symbols are phrases. Their suffixes
are sorted by their prefixes, as many phrases as make 200 bytes; what comes after these bytes decides nothing, so the sort
goes no deeper. Then neighbours are compared by their prefixes: where they agree, those bytes repeat. A phrase is shorter than
that, so that one occurs again settles nothing by itself. Of equal prefixes in a piece only the first one is sorted.

Where a repeat begins or ends between anchors, its outermost windows reach beyond its phrases. These are the windows of
the anchors that the suffix order has not covered, and each is compared with those of equal k-gram. Thirteen windows that start
one after the other are a node: the bytes that all of them hold, and up to twelve on either side. A node whose
middle occurs once holds no repeat; one that occurs twice as a whole repeats in whole; the windows of the rest are rows
that meet by the digest of the middle and the bytes on either side. All these are counts over keys, which are summed before
they are shuffled, so no task holds a group.

Cases. A null or empty text, and any of less than 200 bytes, is kept whole. Rows with the same id and text are two
places of the same bytes. Strings are judged on the input. Columns other than `doc_id` and `text` are not read. Null ids
stay null. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.anchors import GRAM, WINDOW, anchors
from roadgeo.llm.common import by_arrays, by_batch, discard, shuffle_partitions, staged
from roadgeo.llm.suffix_array import BASE, equal_neighbours

#: Windows of a node, which lie in its middle and up to SIDE bytes on either side of it.
STEP = 13
SIDE = STEP - 1
MIDDLE = WINDOW - SIDE
#: Suffixes that are compared with their neighbours at once.
NEIGHBOURS = 1 << 16

#: What is stored of an anchor, and of a phrase in a piece.
_STORED = np.dtype([("gram", "<i8"), ("phrase", "<i8"), ("name", "<i8"), ("first", "<i4"), ("gap", "<i2"), ("count", "<i2"), ("place", "<i2")])
_SYMBOL = np.dtype([("gram", "<i8"), ("phrase", "<i8"), ("gap", "<i2")])

_ANCHORED = "doc bigint, row bigint, anchors binary"
_PHRASE = "gram bigint, phrase bigint, doc bigint, row bigint, seq int"
_FIELDS = ["seq", "gram", "phrase", "name", "first", "gap", "count", "place", "again"]
_KEPT = "doc bigint, row bigint, copies bigint, anchors array<struct<seq:int,gram:bigint,phrase:bigint,name:bigint,first:int,gap:smallint,count:smallint,place:smallint,again:boolean>>"
_PIECE = "piece binary, doc bigint, row bigint, copies bigint, start int, symbols binary"
_ANCHOR = "gram bigint, name bigint, doc bigint, row bigint, first int, count smallint, place smallint, covered boolean, copies bigint"
_NODE = "middle binary, before binary, after binary, doc bigint, row bigint, at int, own boolean"


def _hashes(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64).view(np.int64)


def _anchored(ids, rows, texts):
    """The anchors of each text: its k-gram, phrase, the phrase's step to the next anchor (0 for the last one), all that its windows cover."""
    for doc_id, row, text in zip(ids, rows, texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        at, grams, first, last = anchors(raw)
        if len(at):
            view, out = memoryview(raw), np.empty(len(at), _STORED)
            gaps = np.append(np.diff(at), 0)
            out["gram"], out["first"], out["gap"], out["count"], out["place"] = grams.view(np.int64), first, gaps, last - first + 1, at - first
            out["phrase"], out["name"] = _hashes(view, at, at + gaps + GRAM), _hashes(view, first, last + WINDOW)
            yield doc_id, row, out.tobytes()


def _phrases(ids: pa.Array, rows: pa.Array, stored: pa.Array) -> list[np.ndarray]:
    """A row for each anchor."""
    blobs = stored.to_pylist()
    sizes = np.array([len(x) for x in blobs], np.int64) // _STORED.itemsize
    every = np.frombuffer(b"".join(blobs), _STORED)
    seq = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [np.ascontiguousarray(every["gram"]), np.ascontiguousarray(every["phrase"]), np.repeat(ids.to_numpy(), sizes), np.repeat(rows.to_numpy(), sizes), seq.astype(np.int32)]


def _kept(ids: pa.Array, rows: pa.Array, copies: pa.Array, stored: pa.Array, codes: pa.Array) -> list:
    """Of each text, the anchors whose codes, twice their place and one if the phrase occurs again, are given."""
    parts = []
    for blob, code in zip(stored.to_pylist(), codes):
        # Equal rows give the same codes.
        own = np.unique(code.values.to_numpy(zero_copy_only=False))
        parts.append((own, np.frombuffer(blob, _STORED)[own >> 1]))
    own, every = (np.concatenate(x) for x in zip(*parts))
    columns = {"seq": (own >> 1).astype(np.int32), "again": (own & 1).astype(bool)} | {c: np.ascontiguousarray(every[c]) for c in _STORED.names}
    offsets = np.append(0, np.cumsum([len(x) for x, _ in parts])).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(columns[c]) for c in _FIELDS], names=_FIELDS)
    return [ids, rows, copies, pa.ListArray.from_arrays(pa.array(offsets), values)]


def _columns(lists: pa.Array) -> tuple[dict[str, np.ndarray], list[int]]:
    """The fields of all structs in an array of their lists; where each list ends among them, after a zero."""
    values, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return {f.name: values.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(values.type)}, np.append(0, np.cumsum(sizes)).astype(int).tolist()


def _pieces(ids: pa.Array, rows: pa.Array, copies: pa.Array, kept: pa.Array) -> list[list]:
    """Maximal sequences of phrases that all occur again and together reach a window's length."""
    x, ends = _columns(kept)
    inside = x["again"] & (x["gap"] > 0)
    symbols = np.empty(len(inside), _SYMBOL)
    for c in _SYMBOL.names:
        symbols[c] = x[c]
    out = []
    for doc_id, row, n, low, high in zip(ids.to_pylist(), rows.to_pylist(), copies.to_pylist(), ends, ends[1:]):
        at = low + np.flatnonzero(inside[low:high])
        new = np.flatnonzero(np.append(True, np.diff(x["seq"][at]) != 1)) if len(at) else []
        for a, b in zip(new, [*new[1:], len(at)]):
            own = symbols[at[a] : at[b - 1] + 1]
            if int(own["gap"].sum(dtype=np.int64)) + GRAM >= WINDOW:
                key = hashlib.blake2b(np.array([own["gram"], own["phrase"]]).tobytes(), digest_size=16).digest()
                out.append((key, doc_id, row, n, int(x["first"][at[a]]) + int(x["place"][at[a]]), own.tobytes()))
    return [list(c) for c in zip(*out)] or [[]]


def _prefix_ends(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of a piece that reaches a window's length: the phrase after the first ones that do; and the phrases' places in bytes."""
    places = np.append(0, np.cumsum(gaps.astype(np.int64)))
    ends = np.searchsorted(places, places[:-1] + WINDOW - GRAM)
    return ends[ends < len(places)], places


def _prefixes(own: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The suffixes' prefixes: their phrases, which sort them, and a digest of phrases and k-grams."""
    phrases, both = own["phrase"].astype(">i8").tobytes(), np.stack([own["gram"], own["phrase"]], 1).tobytes()
    return (phrases[8 * k : 8 * end] + xxhash.xxh3_128_digest(both[16 * k : 16 * end]) for k, end in enumerate(ends.tolist()))


def _suffixes(pieces, symbols_):
    """The first suffix of each prefix in a piece, of those that reach a window's length."""
    for piece, symbols in zip(pieces, symbols_):
        own, seen = np.frombuffer(symbols, _SYMBOL), set()
        for k, prefix in enumerate(_prefixes(own, _prefix_ends(own["gap"])[0])):
            if prefix not in seen:
                seen.add(prefix)
                yield piece, k, prefix


def _spans(pieces, symbols_, whole, found):
    """Bytes of a piece, from its start, that its repeated prefixes cover: those found, and those that occur twice in it."""
    for piece, symbols, all_, numbers in zip(pieces, symbols_, whole, found):
        own = np.frombuffer(symbols, _SYMBOL)
        ends, places = _prefix_ends(own["gap"])
        at = np.arange(len(ends))
        if not all_:
            first: dict[bytes, int] = {}
            like = np.array([first.setdefault(p, k) for k, p in enumerate(_prefixes(own, ends))])
            again = np.bincount(like) > 1
            again[numbers or []] = True
            at = at[again[like]]
        start, end = places[at], places[ends[at]] + GRAM
        if len(at):
            # Starts and ends both ascend.
            new = np.append(True, start[1:] > end[:-1])
            yield piece, [{"start": a, "end": b} for a, b in zip(start[new].tolist(), end[np.append(new[1:], True)].tolist())]


def suffix_marks(kept: DataFrame, base: int = BASE) -> DataFrame:
    """Marks (doc, row, start, end) of the phrases that repeat over 200 bytes and more, by the order of the suffixes of the different pieces."""
    pieces = staged(by_arrays(kept.select("doc", "row", "copies", "anchors"), _pieces, _PIECE), "repeat-pieces")
    different = staged(pieces.groupBy("piece").agg((F.sum("copies") > 1).alias("twice"), F.first("symbols").alias("symbols")), "repeat-different")
    # No task sorts many more than `base` suffixes.
    total = different.agg(F.sum(F.length("symbols"))).first()[0] or 0
    slices = max(shuffle_partitions(kept.sparkSession), -(-total // (_SYMBOL.itemsize * base)))
    suffixes = by_batch(different.select("piece", "symbols"), _suffixes, "piece binary, k int, prefix binary", 50)
    equal = equal_neighbours(suffixes, slices, NEIGHBOURS, "repeat-order")
    found = equal.groupBy("piece").agg(F.collect_set("k").alias("found"))
    judged = different.join(found, "piece", "left").select("piece", "symbols", "twice", "found")
    spans = by_batch(judged, _spans, "piece binary, spans array<struct<start:int,end:int>>")
    marks = pieces.select("piece", "doc", "row", F.col("start").alias("at")).join(spans, "piece").select("doc", "row", "at", F.inline("spans"))
    marks = staged(marks.select("doc", "row", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")), "repeat-marks")
    discard(pieces, different)
    return marks


def _marks_by_row(marks: DataFrame) -> DataFrame:
    """The marks of each row, each one number: start and end."""
    code = F.col("start").cast("bigint") * (1 << 32) + F.col("end")
    return marks.groupBy("doc", "row").agg(F.collect_list(code).alias("marks"))


def _judged(ids: pa.Array, rows: pa.Array, copies: pa.Array, kept: pa.Array, marks: pa.Array) -> list[np.ndarray]:
    """The anchors, and whether a mark covers all their windows."""
    x, borders = _columns(kept)
    covered = np.zeros(borders[-1], bool)
    last = x["first"].astype(np.int64) + x["count"] - 1 + WINDOW
    for low, high, marked in zip(borders, borders[1:], marks):
        if marked.is_valid:
            codes = np.sort(marked.values.to_numpy())
            starts, ends = codes >> 32, np.maximum.accumulate(codes & 0xFFFFFFFF)
            # Marks that overlap or touch are one.
            new = np.append(True, starts[1:] > ends[:-1])
            starts, ends = starts[new], ends[np.append(new[1:], True)]
            by = np.searchsorted(starts, x["first"][low:high], "right") - 1
            covered[low:high] = (by >= 0) & (last[low:high] <= ends[by])
    sizes = np.diff(borders)
    own = (np.repeat(c.to_numpy(), sizes) for c in (ids, rows, copies))
    return [x["gram"], x["name"], next(own), next(own), x["first"], x["count"], x["place"], covered, next(own)]


def _nodes(ids, rows, texts, wanted):
    """The nodes of the wanted anchors."""
    for doc_id, row, text, own in zip(ids, rows, texts, wanted):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for x in own:
            at, high = x["first"] + x["place"], x["place"]
            low = high - x["count"] + 1
            for g in range(low // STEP, high // STEP + 1):
                start = at - g * STEP
                before, after = raw[at - min(high, g * STEP + SIDE) : start], raw[start + MIDDLE : at + WINDOW - max(low, g * STEP)]
                yield xxhash.xxh3_128_digest(raw[start : start + MIDDLE], seed=g), before, after, doc_id, row, start, x["own"]


def edge_marks(docs: DataFrame, kept: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks of the repeated windows of anchors that the given marks do not cover."""
    joined = kept.join(_marks_by_row(marks), ["doc", "row"], "left").select("doc", "row", "copies", "anchors", "marks")
    rows = staged(by_arrays(joined, _judged, _ANCHOR), "edge-anchors")
    # Any one of the places of a name: all columns are of the same row.
    place = [F.first(c).alias(c) for c in ("doc", "row", "first", "count", "place")]
    names = staged(rows.groupBy("gram", "name").agg(F.sum("copies").alias("n"), F.min("covered").alias("covered"), *place), "edge-names")
    # All bytes of such an anchor's windows occur twice.
    again = rows.where("not covered").join(names.where("n > 1 and not covered").select("gram", "name"), ["gram", "name"])
    whole = again.select("doc", "row", F.col("first").alias("start"), (F.col("first") + F.col("count") + WINDOW - 1).cast("int").alias("end"))
    open_ = (F.col("n") == 1) & ~F.col("covered")
    grams = names.groupBy("gram").agg(F.max(open_).alias("open"), F.count("*").alias("names")).where("open and names > 1").select("gram")
    wanted = names.join(grams, "gram").select("doc", "row", "first", "count", "place", open_.alias("own"))
    by_doc = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "count", "place", "own")).alias("wanted"))
    texts = docs.select("doc", "row", "text").join(by_doc, ["doc", "row"])
    texts = texts.groupBy("doc", "row").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    nodes = staged(by_batch(texts, _nodes, _NODE), "edge-nodes")
    key = ["middle", "before", "after"]
    # Most middles occur once.
    middles = nodes.groupBy("middle").agg(F.count("*").alias("rows")).where("rows > 1").select("middle")
    shared = staged(nodes.join(middles, "middle"), "edge-shared")
    discard(nodes)
    alone = (F.col("n") == 1) & F.col("own")
    kinds = staged(shared.groupBy(*key).agg(F.count("*").alias("n"), F.max("own").alias("own"), *(F.first(c).alias(c) for c in ("doc", "row", "at"))), "edge-kinds")
    open_middles = kinds.groupBy("middle").agg(F.count("*").alias("kinds"), F.max(alone).alias("open")).where("kinds > 1 and open").select("middle")
    full = shared.where("own").join(kinds.where("n > 1 and own").select(*key), key)
    full = full.select("doc", "row", (F.col("at") - F.length("before")).alias("start"), (F.col("at") + MIDDLE + F.length("after")).alias("end"))
    step = F.explode(F.sequence(F.lit(SIDE) - F.length("after"), F.length("before")))
    windows = kinds.join(open_middles, "middle").select("middle", "before", "after", "doc", "row", "at", alone.alias("own"), step.alias("e"))
    sides = F.concat(F.expr("substring(before, length(before) - e + 1, e)"), F.expr(f"substring(after, 1, {SIDE} - e)"))
    windows = windows.select("middle", "e", sides.alias("sides"), "doc", "row", "at", "own")
    # Several windows of one key go into a few numbers: who they are matters only if they are marked.
    twice = windows.groupBy("middle", "e", "sides").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("middle", "e", "sides")
    single = windows.where("own").join(twice, ["middle", "e", "sides"])
    single = single.select("doc", "row", (F.col("at") - F.col("e")).alias("start"), (F.col("at") - F.col("e") + WINDOW).alias("end"))
    out = staged(whole.union(full).union(single), "edge-marks")
    discard(rows, names, shared, kinds)
    return out


def _finish(ids, texts, marks):
    for doc_id, text, own in zip(ids, texts, marks):
        raw = (text or "").encode("utf-8", "surrogatepass")
        codes = np.unique(np.array(own or [], np.int64))
        starts, ends = codes >> 32, codes & 0xFFFFFFFF
        marks_ = np.stack([starts, ends], 1).tolist()
        kept, at, removed, spans = [], 0, 0, 0
        if len(codes):
            # Marks that overlap or touch are one.
            ends = np.maximum.accumulate(ends)
            new = np.append(True, starts[1:] > ends[:-1])
            for start, end in zip(starts[new].tolist(), ends[np.append(new[1:], True)].tolist()):
                kept.append(raw[at:start])
                spans, removed, at = spans + 1, removed + end - start, end
        kept.append(raw[at:])
        yield doc_id, len(raw), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest(), marks_


def dedup(docs: DataFrame, base: int = BASE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the marks of each row."""
    # doc and row tell rows apart, as far as they differ.
    doc = F.coalesce("doc_id", F.lit(0).cast("bigint"))
    texts = docs.select("doc_id", doc.alias("doc"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("row"), "text")
    anchored = staged(by_batch(texts.select("doc", "row", "text"), _anchored, _ANCHORED), "anchors")
    rows = by_arrays(anchored, _phrases, _PHRASE)
    phrases = rows.groupBy("gram", "phrase").agg(F.count("*").alias("n"))
    repeated = phrases.groupBy("gram").agg(F.sum("n").alias("all")).where("all > 1").select("gram")
    shared = rows.join(phrases.join(repeated, "gram").select("gram", "phrase", (F.col("n") > 1).alias("again")), ["gram", "phrase"])
    codes = shared.groupBy("doc", "row").agg(F.collect_list(F.col("seq") * 2 + F.col("again").cast("int")).alias("codes"))
    own = anchored.groupBy("doc", "row").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors"))
    kept = staged(by_arrays(own.join(codes, ["doc", "row"]).select("doc", "row", "copies", "anchors", "codes"), _kept, _KEPT), "anchors-shared")
    discard(anchored)
    found = suffix_marks(kept, base)
    edges = edge_marks(texts, kept, found)
    ready = texts.join(_marks_by_row(found.union(edges)), ["doc", "row"], "left")
    return by_batch(ready.select("doc_id", "text", "marks"), _finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, marks array<array<int>>")
