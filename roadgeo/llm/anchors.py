"""Content-cut anchors of byte strings.

Every window of WINDOW bytes is given to one of its k-grams, that of smallest hash, the leftmost on a tie. Equal windows
choose the same place in themselves, wherever they stand, and neighbouring windows mostly choose the same k-gram. So
an anchor stands for a run of windows, of which there are few dozens on average and never more than STEPS.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 200, 32
STEPS = WINDOW - GRAM + 1
#: Windows handled at once: positions within a piece fit the low bits of a number.
PIECE = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the k-gram at each position, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    step, factor = 1, np.uint64(0xD1342543DE82EF95)
    with np.errstate(over="ignore"):
        while step < GRAM:
            h = h[:-step] * factor + h[step:]
            h ^= h >> np.uint64(29)
            factor = factor * factor | np.uint64(1)
            step *= 2
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(31))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` numbers."""
    n = len(x)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(rows, axis=1).ravel()
    m = n - width + 1
    return np.minimum(ahead[:m], back[width - 1 : width - 1 + m])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor in order: its position, its hash, and its first and last window. Nothing for texts without a window."""
    data = np.frombuffer(raw, np.uint8)
    total = len(data) - WINDOW + 1
    out = []
    for start in range(0, max(0, total), PIECE):
        windows = min(PIECE, total - start)
        h = gram_hashes(data[start : start + windows + WINDOW - 1])
        packed = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        at = (_smallest(packed, STEPS) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        out.append((at[first] + start, h[at[first]], first + start, last + start))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, h, first, last = (np.concatenate(x) for x in zip(*out))
    # A run of windows that two pieces share is one.
    new = np.append(True, at[1:] != at[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return at[new], h[new], first[new], last[ends]
