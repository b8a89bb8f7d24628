"""Language identification by bit-sliced Bloom filters of letter n-grams.

The n-grams are runs of one to three letters, lower-cased, a space standing for whatever lies between words. Of each language
a document's n-grams count by their share of the document, so that every document has one vote of a size. A language contains
those n-grams whose mean share is at least FLOOR, and at least RATIO of their mean share in the language that has most of them.
The floor bounds a language's list: the shares of one length add up to one.

A filter has a mask at each position, with a bit for each language: a slice of the masks is an ordinary Bloom filter of one
language, and the masks at an n-gram's HASHES positions, joined by AND, give all languages that contain it. A text's hits are
counted for each language (the popcount of its slice over the n-grams) and corrected for those that chance gives, which the
slice's fill tells. The language of most corrected hits is predicted, and its share of them is the score.

Cases. A null text, or one without letters, is `und` with score 0, and so is all where nothing can be learnt. Of equal hits, or
none, the language with more documents is taken, then the smaller name. Rows without an id, text or language, and repeated
rows: a null id is not held out; without a text or a language nothing is learnt; a repeated row has a vote for each time.
Texts of any length are read whole, in slices. Columns other than `doc_id`, `text` and `lang` are not read, and `lang` only
to learn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import discard, staged

SIZES = 3
FLOOR, RATIO = 1 / 50_000, 0.5
#: A document's shares are counted in units of 1 / VOTE.
VOTE = 1 << 24
HASHES, LOAD = 4, 12
#: Remainder of crc32(doc_id) by 3 that is not learnt from.
HELD_OUT = 1
UNKNOWN = "und"
#: Bits that a letter takes in the key of an n-gram; letters lie below 1 << 18.
LETTER = 18
#: Documents and code points looked at together.
AT_ONCE, SLICE = 1000, 1 << 22


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == HELD_OUT, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << LETTER)), bool, 1 << LETTER)


@dataclass
class Texts:
    """The letters of some texts in a row, each text with spaces around its words, as numbers in a small alphabet."""

    places: np.ndarray  # numbers of letters in the alphabet, 0 for a space
    starts: np.ndarray  # where each text begins, and the end
    alphabet: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        rows = [_worded(t) for t in texts]
        codes = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        seen = np.zeros(1 << LETTER, bool)
        seen[codes] = True
        seen[0] = True
        alphabet = np.flatnonzero(seen)
        number = np.zeros(1 << LETTER, np.int32)
        number[alphabet] = np.arange(len(alphabet))
        return cls(number[codes], np.cumsum([0, *map(len, rows)]), alphabet)

    def grams(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and numbers of the n-grams of one size that do not reach over a space, slice by slice. A number writes
        the letters in the alphabet's base."""
        base, end = len(self.alphabet), len(self.places) - size + 1
        for at in range(0, end, SLICE):
            parts = [self.places[at + i : min(at + SLICE, end) + i] for i in range(size)]
            inner = parts if size == 1 else parts[1:-1] or [parts[0] | parts[1]]
            fits = np.logical_and.reduce([p > 0 for p in inner])
            number = np.zeros(len(parts[0]), np.int64)
            for p in parts:
                number = number * base + p
            yield at + np.flatnonzero(fits), number[fits]

    def keys(self, numbers: np.ndarray, size: int) -> np.ndarray:
        """The n-grams' keys, the same in all texts: the size, then the letters."""
        key, base = np.zeros(len(numbers), np.int64), len(self.alphabet)
        for i in range(size):
            key |= self.alphabet[numbers // base**i % base] << LETTER * i
        return key | size << LETTER * SIZES

    def owners(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _worded(text: str | None) -> np.ndarray:
    """Lower-case letters of a text, with one space (0) before, between and after its words."""
    if not text:
        return np.zeros(0, np.int32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
    codes = np.where(codes < 1 << LETTER, codes, 0)
    codes = np.concatenate([[0], np.where(_letters()[codes], codes, 0), [0]]).astype(np.int32)
    return codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])] if codes.any() else np.zeros(0, np.int32)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts to be looked at together: AT_ONCE of them, or as many as SLICE code points hold, but one at least."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and (i - first == AT_ONCE or size + len(text or "") > SLICE):
            yield first, i
            first, size = i, 0
        size += len(text or "")
    if texts:
        yield first, len(texts)


def _summed(numbers: np.ndarray, weights: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers below a bound, and the sums of their weights."""
    if bound <= 1 << 22:
        sums = np.bincount(numbers, weights, bound)
        found = np.flatnonzero(sums)
        return found, sums[found]
    found, where = np.unique(numbers, return_inverse=True)
    return found, np.bincount(where, weights, len(found))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of n-grams of the documents of each language: lang, gram, votes."""
    for batch in batches:
        for lang, rows in pd.Series(batch["text"].to_pylist()).groupby(np.array(batch["lang"].to_pylist(), object)):
            for first, end in _parts(rows.tolist()):
                texts = Texts.of(rows.iloc[first:end].tolist())
                for size in range(1, SIZES + 1):
                    counts = np.zeros(len(texts.starts) - 1, np.int64)
                    for places, _ in texts.grams(size):
                        counts += np.bincount(texts.owners(places), minlength=len(counts))
                    worth = np.maximum(1, VOTE // np.maximum(counts, 1))
                    for places, numbers in texts.grams(size):
                        found, votes = _summed(numbers, worth[texts.owners(places)], len(texts.alphabet) ** size)
                        yield pa.RecordBatch.from_pydict(
                            {"lang": pa.array([lang] * len(found), pa.string()), "gram": texts.keys(found, size), "votes": votes.astype(np.int64)})


def contained(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The languages with their numbers of documents (lang, n), and the n-grams that each contains (lang, gram), both stored."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("text", "lang")
    langs = staged(known.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    votes = staged(known.mapInArrow(_votes, "lang string, gram bigint, votes bigint").groupBy("gram", "lang").agg(F.sum("votes").alias("votes")), "gram-votes")
    share = votes.join(langs, "lang").select("lang", "gram", (F.col("votes") / (F.col("n") * F.lit(float(VOTE)))).alias("share"))
    most = share.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.when(F.col("share") >= FLOOR, F.struct("lang", "share"))).alias("of"))
    kept = staged(most.select("gram", "most", F.explode("of").alias("one")).where(F.col("one.share") >= RATIO * F.col("most")).select("one.lang", "gram"), "grams")
    discard(votes)
    return langs, kept


def positions(keys: np.ndarray, slots: int) -> np.ndarray:
    """HASHES positions of each key, by double hashing."""
    x = keys.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    step = x >> np.uint64(32) | np.uint64(1)
    return ((x[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


class Filter:
    """Masks of languages, in words of 64 bits: an array of slots by words."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        fill = np.array([float(np.count_nonzero(masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1))) / len(masks) for i in range(len(langs))])
        #: How often a slice answers to an n-gram that its language does not contain.
        self.chance = fill**HASHES

    def languages(self, keys: np.ndarray) -> np.ndarray:
        """The mask of languages of each n-gram."""
        at = positions(keys, len(self.masks))
        return np.bitwise_and.reduce([self.masks[at[:, i]] for i in range(HASHES)])

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of n-grams of each text, and of those that each language's slice answers to."""
        n = len(texts.starts) - 1
        total, hits = np.zeros(n, np.int64), np.zeros((n, len(self.langs)), np.int64)
        for size in range(1, SIZES + 1):
            for places, numbers in texts.grams(size):
                owner = texts.owners(places)
                total += np.bincount(owner, minlength=n)
                found, _ = _summed(numbers, np.ones(len(numbers)), len(texts.alphabet) ** size)
                masks = self.languages(texts.keys(found, size))[np.searchsorted(found, numbers)]
                for i in range(len(self.langs)):
                    bit = masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)
                    hits[:, i] += np.bincount(owner[bit > 0], minlength=n)
        return total, hits

    def decide(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text."""
        total, hits = self.hits(Texts.of(texts))
        for n, row in zip(total, hits):
            if not n or not self.langs:
                yield UNKNOWN, 0.0
                continue
            true = np.maximum(0.0, (row - self.chance * n) / np.maximum(1 - self.chance, 1e-9))
            best = int(np.argmax(true))
            yield self.langs[best], float(true[best] / true.sum()) if true[best] else 0.0


def build(langs: DataFrame, grams: DataFrame) -> Filter:
    """The filter of the languages; its size follows from the longest list, which FLOOR bounds by SIZES / FLOOR n-grams."""
    names = [r["lang"] for r in langs.orderBy(F.desc("n"), "lang").collect()]
    longest = grams.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << int(LOAD * longest - 1).bit_length()
    words = max(1, -(-len(names) // 64))
    bit = {lang: i for i, lang in enumerate(names)}
    slab = min(slots, 1 << 16)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = batch["lang"].map(bit).to_numpy(np.int64).repeat(HASHES)
            at = positions(batch["gram"].to_numpy(), slots).ravel()
            mask = np.left_shift(np.int64(1), of & 63)
            yield pd.DataFrame({"slab": at // slab, "at": (at % slab) * words + (of >> 6), "mask": mask})

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        masks = np.zeros(slab * words, np.int64)
        masks[group["at"].to_numpy()] = group["mask"].to_numpy()
        return pd.DataFrame({"slab": [group["slab"].iloc[0]], "masks": [masks.tobytes()]})

    joined = grams.mapInPandas(placed, "slab bigint, at bigint, mask bigint").groupBy("slab", "at").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((slots // slab, slab * words), np.uint64)
    for r in joined.groupBy("slab").applyInPandas(packed, "slab bigint, masks binary").collect():
        masks[r["slab"]] = np.frombuffer(r["masks"], np.uint64)
    return Filter(names, masks.reshape(slots, words))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    langs, grams = contained(docs)
    model = docs.sparkSession.sparkContext.broadcast(build(langs, grams))
    discard(langs, grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for first, end in _parts(texts):
                part = batch.slice(first, end - first)
                pred, score = zip(*model.value.decide(texts[first:end]))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())})

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
