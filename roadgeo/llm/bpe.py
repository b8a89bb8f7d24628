"""Byte-level BPE encoding and decoding.

A piece (one match of the splitting pattern) is merged on a segment tree over its byte positions: each leaf holds the
rank of the pair that starts there, or none; each inner node holds the smaller of its children, the left one on a tie,
so the root is the leftmost pair of minimum rank. A merge unlinks one position and updates the leaves of the two live
neighbours, in logarithmic time each. A piece of n bytes takes O(n log n), also when it is one run of a million signs.

Short pieces are merged together: one matrix holds a tree in each row, and each step does one merge in every row that
has one left. A worker keeps the ids of pieces it has met, up to a fixed number, and starts anew when the table is
full. Ranks travel by path and are read once a worker.

Cases. A null text is empty: no tokens, and the digests of nothing. Repeated rows are encoded each by itself. Long texts
are walked piece by piece, whole. Columns other than `doc_id` and `text` are not read. Null ids stay null.
"""

from __future__ import annotations

import base64
import hashlib

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from roadgeo.llm.common import by_batch, by_row

NONE = 1 << 60
#: Of the matrix form: no rank, no entry, and the widths of its trees. Longer pieces are merged one by one.
NO_RANK, NO_PAIR, SIZES = 1 << 20, (1 << 31) - 1, (8, 16, 32, 64)
#: Distinct pieces kept by a worker, and the longest that is kept.
KEPT_PIECES, KEPT_LENGTH = 300_000, 32
#: Pieces looked up together; a text of more code points is walked in parts.
AT_ONCE, LONG = 200_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by repeated merging of the leftmost pair of lowest rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    # best[size + i] is (rank, i) packed into one number, so that the smaller number is the leftmost minimum.
    shift = size.bit_length()
    best = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # end[i]: where the token that starts at i ends
    before = list(range(-1, n - 1))  # before[i]: start of the token in front
    get = ranks.get

    def key(i: int) -> int:
        j = end[i]
        if j >= n:
            return NONE
        rank = get(piece[i : end[j]])
        return NONE if rank is None else rank << shift | i

    for i in range(n):
        best[size + i] = key(i)
    for k in range(size - 1, 0, -1):
        a, b = best[2 * k], best[2 * k + 1]
        best[k] = a if a <= b else b

    def put(i: int, value: int) -> None:
        k = size + i
        best[k] = value
        k >>= 1
        while k:
            a, b = best[2 * k], best[2 * k + 1]
            new = a if a <= b else b
            if best[k] == new:
                break
            best[k] = new
            k >>= 1

    low = (1 << shift) - 1
    while best[1] < NONE:
        i = best[1] & low
        gone = end[i]
        end[i] = end[gone]
        if end[i] < n:
            before[end[i]] = i
        put(gone, NONE)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def merge_all(pieces: list[bytes], size: int, pairs: Pairs) -> list[bytes]:
    """Ids of many short pieces, as int32 bytes: a segment tree in each row of one matrix, one merge a row and step."""
    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int32, m)
    text = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    at = np.arange(size, dtype=np.int32)
    live = at < lengths[:, None]
    token = np.where(live, pairs.byte_ids[text], -1)
    # after and before: the live neighbours of each position; `size` and -1 stand for none.
    after = np.where(at + 1 < lengths[:, None], at + 1, size).astype(np.int32)
    before = np.broadcast_to(at - 1, (m, size)).copy()
    shift = size.bit_length()
    tree = np.full((m, 2 * size), NO_PAIR, np.int32)
    first = pairs.ranks(token[:, :-1], token[:, 1:])
    tree[:, size : 2 * size - 1] = np.where(first < NO_RANK, first << shift | at[:-1], NO_PAIR)
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(rows):
        root = tree[rows, 1]
        i = root & ((1 << shift) - 1)
        j = after[rows, i]
        token[rows, i], token[rows, j] = root >> shift, -1
        tree[rows, size + j] = NO_PAIR
        nxt, prev = after[rows, j], before[rows, i]
        after[rows, i] = nxt
        some = nxt < size
        before[rows[some], nxt[some]] = i[some]
        rank = np.full(len(rows), NO_RANK, np.int32)
        rank[some] = pairs.ranks(token[rows[some], i[some]], token[rows[some], nxt[some]])
        tree[rows, size + i] = np.where(rank < NO_RANK, rank << shift | i, NO_PAIR)
        some = prev >= 0
        r, p = rows[some], prev[some]
        rank = pairs.ranks(token[r, p], token[r, i[some]])
        tree[r, size + p] = np.where(rank < NO_RANK, rank << shift | p, NO_PAIR)
        r, node = np.concatenate([rows, rows, r]), np.concatenate([i, j, p]) + size
        for _ in range(shift - 1):
            node >>= 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        rows = rows[tree[rows, 1] < NO_PAIR]
    kept = token >= 0
    flat, ends = token[kept].tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Pairs:
    """Rank of the token that two tokens join to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        joined = {ranks[t[:c]] << 16 | ranks[t[c:]]: r for t, r in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks}
        self.keys = np.array(sorted(joined), np.uint32)
        self.values = np.array([joined[k] for k in self.keys.tolist()], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[where] == key) & (right >= 0), self.values[where], NO_RANK).astype(np.int32)


SIZE_OF = [next(s for s in SIZES if n <= s) for n in range(SIZES[-1] + 1)]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Codec:
    """Ranks, their inverse and the pieces met so far."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.pairs = Pairs(self.ranks) if len(self.tokens) <= 1 << 16 and all(bytes([b]) in self.ranks for b in range(256)) else None
        self.pattern = regex.compile(pattern)
        self.met: dict[str, bytes] = {}  # piece to its ids, as int32 bytes

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces not met before."""
        ids, by_size = {}, {s: ([], []) for s in SIZES}
        ranks, many = self.ranks, self.pairs is not None
        for piece in pieces:
            b = piece.encode()
            if b in ranks:
                ids[piece] = _packed([ranks[b]])
            elif many and len(b) <= SIZES[-1]:
                new, raw = by_size[SIZE_OF[len(b)]]
                new.append(piece)
                raw.append(b)
            else:
                ids[piece] = _packed(merge(b, ranks))
        for size, (new, raw) in by_size.items():
            for start in range(0, len(new), 20_000):
                ids.update(zip(new[start : start + 20_000], merge_all(raw[start : start + 20_000], size, self.pairs)))
        return ids

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, of those not met before all at once."""
        if len(self.met) > KEPT_PIECES:
            self.met.clear()
        found = list(map(self.met.get, pieces))
        learnt = self._learn({p for p, x in zip(pieces, found) if x is None})
        if learnt:
            self.met.update(x for x in learnt.items() if len(x[0]) <= KEPT_LENGTH)
            found = [learnt[p] if x is None else x for p, x in zip(pieces, found)]
        return found

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order. Pieces of several short texts, or parts of a long one, are looked up together."""
        group: list[str] = []
        counts: list[int] = []
        for text in texts:
            if len(text) > LONG:
                yield from self._split(group, counts)
                group, counts = [], []
                walk, ids = (m.group() for m in self.pattern.finditer(text)), []
                while part := list(islice(walk, AT_ONCE)):
                    ids.append(b"".join(self._ids(part)))
                yield np.frombuffer(b"".join(ids), np.int32)
                continue
            pieces = self.pattern.findall(text)
            group += pieces
            counts.append(len(pieces))
            if len(group) > AT_ONCE:
                yield from self._split(group, counts)
                group, counts = [], []
        yield from self._split(group, counts)

    def _split(self, group: list[str], counts: list[int]) -> Iterator[np.ndarray]:
        ids, at = self._ids(group), 0
        for n in counts:
            yield np.frombuffer(b"".join(ids[at : at + n]), np.int32)
            at += n

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def digest(self, ids: list[int]) -> str:
        numbers = self.numbers
        return hashlib.sha256(",".join([numbers[i] for i in ids]).encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One for all tasks of a worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """A row per document: number of tokens, digest of the ids, digest of what they decode to; the ids too if asked for."""

    def rows(doc_ids, texts):
        c = codec(path, pattern)
        for doc_id, array in zip(doc_ids, c.encode_all([t or "" for t in texts])):
            ids = array.tolist()
            head = (doc_id, len(ids), c.digest(ids), hashlib.sha256(c.decode(ids)).hexdigest())
            yield (*head, ids) if keep_ids else head

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return by_batch(docs.select("doc_id", "text"), rows, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give a null text."""
    return by_row(encoded.select("doc_id", "ids"), lambda d, ids: (d, None if ids is None else codec(path, pattern).decode(ids).decode()), "doc_id bigint, text string")
