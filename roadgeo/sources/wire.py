"""Protocol-buffer messages as arrays: all messages of one kind in a block are read, and written, together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAD = 10  # bytes that a number may take beyond the end of what holds it


def varint(buf, pos: int) -> tuple[int, int]:
    """One unsigned number and the position after it."""
    value = shift = 0
    while True:
        byte = buf[pos]
        pos += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, pos
        shift += 7


def spans(buf, pos: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(field number, start, end) of nested fields, and (field number, value, -1) of plain numbers."""
    while pos < end:
        key, pos = varint(buf, pos)
        wire = key & 7
        value, pos = varint(buf, pos) if wire in (0, 2) else ({1: 8, 5: 4}[wire], pos)
        if wire == 0:
            yield key >> 3, value, -1
        else:
            yield key >> 3, pos, pos + value
            pos += value
    if pos != end:
        raise ValueError("a field reaches over the end of its message")


def int64(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def numbers(raw: np.ndarray) -> np.ndarray:
    """All unsigned numbers of a packed field."""
    if not len(raw):
        return np.empty(0, np.uint64)
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    raw = raw[: last[-1] + 1]
    shift = 7 * (np.arange(len(raw)) - np.repeat(first, last - first + 1))
    return np.bitwise_or.reduceat((raw & 0x7F).astype(np.uint64) << shift.astype(np.uint64), first)


def signed(values: np.ndarray) -> np.ndarray:
    """Numbers from their zigzag form."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def _at(data: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number at each position, and the positions after them."""
    value, pos = np.zeros(len(pos), np.uint64), pos.copy()
    going = np.arange(len(pos))
    for shift in range(0, 70, 7):
        byte = data[pos[going]]
        value[going] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
        pos[going] += 1
        going = going[byte >= 0x80]
        if not len(going):
            return value, pos
    raise ValueError("a number of more than ten bytes")


class Lists:
    """A packed field of many messages: the numbers of all of them, and how many each has."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        raw = data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        closed = np.concatenate([[0], np.cumsum(raw < 0x80)])
        self.counts = closed[ends] - closed[ends - lengths]
        self.values = numbers(raw)

    def running(self) -> np.ndarray:
        """The numbers, where they are written as differences within their message."""
        total = np.cumsum(signed(self.values))
        if not len(total):
            return total
        first = np.cumsum(self.counts) - self.counts
        before = np.concatenate([[0], total])[np.minimum(first, len(total))]
        return total - np.repeat(before, self.counts)


class Messages:
    """Messages that lie at the given places of a block, which has PAD bytes after its last one.

    The first fields of all messages are read in one step, then the second ones, and so on.
    """

    def __init__(self, data: np.ndarray, starts, ends):
        self.data, self.n = data, len(starts)
        pos, end = np.array(starts, np.int64), np.array(ends, np.int64)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        going = np.flatnonzero(pos < end)
        while len(going):
            key, at = _at(data, pos[going])
            wire, number = key & np.uint64(7), (key >> np.uint64(3)).astype(np.int64)
            sized = (wire == 0) | (wire == 2)
            value, after = at.astype(np.uint64), at + np.where(wire == 1, 8, 4)
            if not np.isin(wire, (0, 1, 2, 5)).all():
                raise ValueError("a field of an unknown form")
            value[sized], after[sized] = _at(data, at[sized])
            start = after.copy()
            after[wire == 2] += value[wire == 2].astype(np.int64)
            for n in np.unique(number):
                values, places = self.found.setdefault(int(n), (np.zeros(self.n, np.uint64), np.full(self.n, -1)))
                some = number == n
                if (places[going[some]] >= 0).any():
                    raise ValueError(f"field {n} occurs twice in a message")
                values[going[some]], places[going[some]] = value[some], start[some]
            pos[going] = after
            if (after > end[going]).any():
                raise ValueError("a field reaches over the end of its message")
            going = going[after < end[going]]

    def plain(self, number: int) -> np.ndarray:
        """The numbers of a field that every message has."""
        values, places = self.found.get(number, (None, np.full(self.n, -1)))
        if (places < 0).any():
            raise ValueError(f"a message without field {number}")
        return values

    def lists(self, number: int) -> Lists:
        """A packed field; messages without it have an empty list."""
        values, places = self.found.get(number, (np.zeros(self.n, np.uint64), np.full(self.n, -1)))
        return Lists(self.data, np.maximum(places, 0), np.where(places < 0, 0, values.astype(np.int64)))


# ---------------------------------------------------------------- writing


class Pieces:
    """Byte strings, one for each message: all their bytes, and their lengths."""

    def __init__(self, raw: np.ndarray, lengths: np.ndarray):
        self.raw, self.lengths = raw, lengths

    def __bytes__(self) -> bytes:
        return self.raw.tobytes()

    @classmethod
    def numbers(cls, values) -> Pieces:
        """Each number by itself."""
        v = np.asarray(values).astype(np.uint64)
        size = np.ones(len(v), np.int64)
        for k in range(1, 10):
            size += v >= np.uint64(1 << 7 * k)
        first = np.cumsum(size) - size
        raw = np.zeros(size.sum(), np.uint8)
        for k in range(10):
            some = size > k
            more = np.where(size[some] > k + 1, 0x80, 0).astype(np.uint8)
            raw[first[some] + k] = (v[some] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.uint8) | more
        return cls(raw, size)

    def grouped(self, counts) -> Pieces:
        """Runs of `counts` strings as one each."""
        ends = np.cumsum(counts)
        size = np.concatenate([[0], np.cumsum(self.lengths)])
        return Pieces(self.raw, size[ends] - size[ends - counts])

    def then(self, *others: Pieces) -> Pieces:
        """Each message's strings, one after the other."""
        parts = [self, *others]
        lengths = np.sum([p.lengths for p in parts], axis=0)
        raw = np.zeros(lengths.sum(), np.uint8)
        at = np.cumsum(lengths) - lengths
        for p in parts:
            own = np.cumsum(p.lengths) - p.lengths
            raw[np.repeat(at - own, p.lengths) + np.arange(len(p.raw))] = p.raw
            at = at + p.lengths
        return Pieces(raw, lengths)

    def field(self, number: int) -> Pieces:
        """The strings as nested fields; empty ones are left out."""
        some = (self.lengths > 0).astype(np.int64)
        key = Pieces.numbers(np.full(some.sum(), number << 3 | 2)).grouped(some)
        return key.then(Pieces.numbers(self.lengths[some > 0]).grouped(some), self)


def plain_field(number: int, values) -> Pieces:
    """A number each, as a field."""
    return Pieces.numbers(np.full(len(values), number << 3)).then(Pieces.numbers(values))


def zigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return (v << 1 ^ v >> 63).view(np.uint64)


def differences(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each number less the one before it in its run of `counts`; the first ones stay."""
    v = np.asarray(values, np.int64)
    out = np.diff(v, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    out[first] = v[first]
    return out
