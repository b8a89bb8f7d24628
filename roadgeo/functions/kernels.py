"""Numpy kernels over Arrow batches of geometries.

A batch is flattened once to coordinate arrays plus offsets; the work is then done on whole
arrays. Spark decides what is in a batch: nothing here sees more than the rows of one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOLYGON", "MULTIPOINT", "MULTILINESTRING")
POINT, LINESTRING, POLYGON, MULTIPOLYGON, MULTIPOINT, MULTILINESTRING = range(6)
AREAL = (POLYGON, MULTIPOLYGON)

ARROW_VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
ARROW_GEOMETRY = pa.struct(
    [("type", pa.string()), ("parts", pa.list_(pa.list_(ARROW_VERTEX)))]
)

# Segment pairs compared at a time; bounds the memory of one step.
PAIR_BLOCK = 1 << 18


# ---------------------------------------------------------------- batches


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offset of each run, given the run lengths."""
    starts = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=starts[1:])
    return starts


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after the other."""
    total = int(counts.sum())
    return np.arange(total) + np.repeat(starts - starts_of(counts), counts)


@dataclass
class Batch:
    """Geometries of one Arrow batch as flat arrays."""

    valid: np.ndarray  # bool per row
    kind: np.ndarray  # index into KINDS per row, -1 for NULL
    part_count: np.ndarray  # parts per row
    size: np.ndarray  # vertices per part
    x: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, arr: pa.Array) -> "Batch":
        kinds, parts = arr.flatten()
        code = pc.fill_null(pc.index_in(kinds, pa.array(KINDS)), -1)
        valid = arr.is_valid().to_numpy(zero_copy_only=False)
        rings = parts.flatten()
        vertices = rings.flatten()
        x, y = vertices.flatten()
        return cls(
            valid,
            code.to_numpy(zero_copy_only=False).astype(np.int64),
            pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64),
            pc.fill_null(pc.list_value_length(rings), 0).to_numpy().astype(np.int64),
            x.to_numpy(zero_copy_only=False),
            y.to_numpy(zero_copy_only=False),
        )

    def __len__(self) -> int:
        return len(self.kind)

    def part_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.part_count)

    def vertex_counts(self) -> np.ndarray:
        """Vertices per row."""
        return np.bincount(
            self.part_rows(), weights=self.size, minlength=len(self)
        ).astype(np.int64)


def to_arrow(
    kind: np.ndarray,
    part_count: np.ndarray,
    size: np.ndarray,
    x: np.ndarray,
    y: np.ndarray,
    null: np.ndarray | None = None,
) -> pa.Array:
    """Flat arrays back to an Arrow geometry array."""
    vertices = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], fields=list(ARROW_VERTEX))
    rings = pa.ListArray.from_arrays(_offsets(size), vertices)
    parts = pa.ListArray.from_arrays(_offsets(part_count), rings)
    kinds = pa.array(KINDS).take(pa.array(np.maximum(kind, 0)))
    mask = None if null is None else pa.array(null)
    return pa.StructArray.from_arrays(
        [kinds, parts], fields=list(ARROW_GEOMETRY), mask=mask
    )


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


# ---------------------------------------------------------------- segments and probes


@dataclass
class Outline:
    """Segments per row, and one probe vertex per part for the inside test."""

    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    start: np.ndarray
    count: np.ndarray
    probe_x: np.ndarray
    probe_y: np.ndarray
    probe_start: np.ndarray
    probe_count: np.ndarray
    areal: np.ndarray

    @classmethod
    def of(cls, b: Batch) -> "Outline":
        """A part with one vertex counts as one segment without length."""
        first = starts_of(b.size)
        part_end = np.repeat(first + b.size, b.size)
        alone = np.repeat(b.size == 1, b.size)
        k = np.arange(len(b.x))
        use = (k + 1 < part_end) | alone
        k = k[use]
        nxt = np.where(alone[use], k, k + 1)
        rows = b.part_rows()
        per_part = np.where(b.size > 1, b.size - 1, b.size)
        count = np.bincount(rows, weights=per_part, minlength=len(b)).astype(np.int64)
        has = b.size > 0
        probes = np.bincount(rows[has], minlength=len(b)).astype(np.int64)
        return cls(
            b.x[k], b.y[k], b.x[nxt], b.y[nxt],
            starts_of(count), count,
            b.x[first[has]], b.y[first[has]],
            starts_of(probes), probes,
            np.isin(b.kind, AREAL),
        )

    def take(self, rows: np.ndarray) -> "Outline":
        """The outlines of some rows, in any order; the segments stay where they are."""
        picked = ("start", "count", "probe_start", "probe_count", "areal")
        return replace(self, **{name: getattr(self, name)[rows] for name in picked})

    def repeated(self, n: int) -> "Outline":
        """The single geometry of this outline, used for ``n`` rows."""
        each = np.zeros(n, np.int64)
        return Outline(
            self.ax, self.ay, self.bx, self.by,
            each, each + self.count[0],
            self.probe_x, self.probe_y,
            each, each + self.probe_count[0],
            np.repeat(self.areal[:1], n),
        )


def _blocks(owner: np.ndarray, index: np.ndarray, start: np.ndarray, count: np.ndarray):
    """Pair every ``index[k]`` with the run of its row ``owner[k]``, in bounded blocks.

    Yields ``(row, i, j)`` arrays: the row, the index, and the member of the run.
    """
    width = count[owner]
    ends = np.cumsum(width)
    done = 0
    while done < len(index):
        before = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + PAIR_BLOCK, "right")))
        w = width[done:stop]
        own = owner[done:stop]
        yield np.repeat(own, w), np.repeat(index[done:stop], w), runs(start[own], w)
        done = stop


def _segment_pairs(a: Outline, b: Outline, rows: np.ndarray):
    """All segment pairs of the given rows, in bounded blocks."""
    owner = np.repeat(rows, a.count[rows])
    return _blocks(owner, runs(a.start[rows], a.count[rows]), b.start, b.count)


# ---------------------------------------------------------------- predicates


def turn(ox, oy, px, py, qx, qy) -> np.ndarray:
    """Exact sign of the turn o -> p -> q.

    The float determinant is trusted beyond its rounding bound; the few cases below it are
    decided with rational numbers.
    """
    left = (px - ox) * (qy - oy)
    right = (py - oy) * (qx - ox)
    det = left - right
    size = np.abs(left) + np.abs(right)
    sign = np.sign(det)
    for k in np.flatnonzero((np.abs(det) <= 4e-16 * size) & (size > 0)):
        o_x, o_y = Fraction(float(ox[k])), Fraction(float(oy[k]))
        exact = (Fraction(float(px[k])) - o_x) * (Fraction(float(qy[k])) - o_y) - (
            Fraction(float(py[k])) - o_y
        ) * (Fraction(float(qx[k])) - o_x)
        sign[k] = (exact > 0) - (exact < 0)
    return sign


def _segments_meet(a: Outline, b: Outline, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Do the closed segments share a point?"""
    near = (
        (np.maximum(a.ax[i], a.bx[i]) >= np.minimum(b.ax[j], b.bx[j]))
        & (np.maximum(b.ax[j], b.bx[j]) >= np.minimum(a.ax[i], a.bx[i]))
        & (np.maximum(a.ay[i], a.by[i]) >= np.minimum(b.ay[j], b.by[j]))
        & (np.maximum(b.ay[j], b.by[j]) >= np.minimum(a.ay[i], a.by[i]))
    )
    k = np.flatnonzero(near)
    i, j = i[k], j[k]
    p, q = (a.ax[i], a.ay[i]), (a.bx[i], a.by[i])
    r, s = (b.ax[j], b.ay[j]), (b.bx[j], b.by[j])
    near[k] = (turn(*r, *s, *p) * turn(*r, *s, *q) <= 0) & (
        turn(*p, *q, *r) * turn(*p, *q, *s) <= 0
    )
    return near


def _inside(shape: Outline, probes: Outline, rows: np.ndarray) -> np.ndarray:
    """Rows where some probe vertex lies inside the areal shape (even-odd rule)."""
    hit = np.zeros(len(shape.count), bool)
    rows = rows[shape.areal[rows]]
    owner = np.repeat(rows, probes.probe_count[rows])
    source = runs(probes.probe_start[rows], probes.probe_count[rows])
    probe = np.arange(len(owner))
    crossings = np.zeros(len(owner), np.int64)
    for _, k, j in _blocks(owner, probe, shape.start, shape.count):
        px, py = probes.probe_x[source[k]], probes.probe_y[source[k]]
        x1, y1, x2, y2 = shape.ax[j], shape.ay[j], shape.bx[j], shape.by[j]
        spans = (y1 > py) != (y2 > py)
        rise = np.where(spans, y2 - y1, 1.0)
        right = spans & (px < x1 + (x2 - x1) * ((py - y1) / rise))
        crossings += np.bincount(k[right], minlength=len(owner))
    hit[owner[crossings % 2 == 1]] = True
    return hit


def intersects(a: Outline, b: Outline) -> np.ndarray:
    """Per row: do the geometries share any point, boundary included?"""
    hit = np.zeros(len(a.count), bool)
    rows = np.flatnonzero((a.count > 0) & (b.count > 0))
    for owner, i, j in _segment_pairs(a, b, rows):
        hit[owner[_segments_meet(a, b, i, j)]] = True
    rest = rows[~hit[rows]]
    return hit | _inside(a, b, rest) | _inside(b, a, rest)


def _point_to_segment(px, py, ax, ay, bx, by) -> np.ndarray:
    """Squared distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    wx, wy = px - ax, py - ay
    length2 = dx * dx + dy * dy
    t = np.clip((wx * dx + wy * dy) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0)
    ex, ey = wx - t * dx, wy - t * dy
    return ex * ex + ey * ey


def distance(a: Outline, b: Outline) -> np.ndarray:
    """Per row: 0 if the geometries meet, else the least segment distance; NaN if one is empty."""
    best = np.full(len(a.count), np.inf)
    rows = np.flatnonzero((a.count > 0) & (b.count > 0))
    for owner, i, j in _segment_pairs(a, b, rows):
        p, q = (a.ax[i], a.ay[i]), (a.bx[i], a.by[i])
        r, s = (b.ax[j], b.ay[j]), (b.bx[j], b.by[j])
        d2 = _point_to_segment(*p, *r, *s)
        np.minimum(d2, _point_to_segment(*q, *r, *s), out=d2)
        np.minimum(d2, _point_to_segment(*r, *p, *q), out=d2)
        np.minimum(d2, _point_to_segment(*s, *p, *q), out=d2)
        d2[_segments_meet(a, b, i, j)] = 0.0
        # Pairs of a row lie together, so one reduction per row and block is enough.
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        if len(head):
            own = owner[head]
            best[own] = np.minimum(best[own], np.minimum.reduceat(d2, head))
    rest = rows[best[rows] > 0]
    best[_inside(a, b, rest) | _inside(b, a, rest)] = 0.0
    return np.where(np.isinf(best), np.nan, np.sqrt(best))


# ---------------------------------------------------------------- buffer

ARC_STEPS = 8  # segments per quarter circle


def _capsule(x1: float, y1: float, x2: float, y2: float, d: float) -> tuple:
    """Convex outline of all points within ``d`` of a segment; arcs start at its normal."""
    steps = np.arange(2 * ARC_STEPS + 1) * (np.pi / (2 * ARC_STEPS))
    along = np.arctan2(y2 - y1, x2 - x1)
    front, back = along - np.pi / 2 + steps, along + np.pi / 2 + steps
    if x1 == x2 and y1 == y2:
        front, back = front[:-1], back[:-1]
    return (
        np.concatenate([x2 + d * np.cos(front), x1 + d * np.cos(back)]),
        np.concatenate([y2 + d * np.sin(front), y1 + d * np.sin(back)]),
    )


def _chains(x: np.ndarray, y: np.ndarray) -> tuple:
    """Lower and upper boundary of a convex outline, left to right."""
    n = len(x)
    order = np.lexsort((y, x))
    left, right = order[0], order[-1]
    # counter-clockwise from the left end runs along the lower side
    lower = (left + np.arange((right - left) % n + 1)) % n
    upper = (right + np.arange((left - right) % n + 1))[::-1] % n
    # an upright side belongs to neither chain: it would give two heights at one x
    lower = lower[: np.count_nonzero(x[lower] < x[right]) + 1]
    upper = upper[np.count_nonzero(x[upper] == x[left]) - 1 :]
    return (x[lower], y[lower]), (x[upper], y[upper])


def _crossing_xs(caps: list) -> np.ndarray:
    """x of every crossing between the outlines of two capsules."""
    lo = np.array([[c[0].min(), c[1].min()] for c in caps])
    hi = np.array([[c[0].max(), c[1].max()] for c in caps])
    found = []
    for k in range(len(caps) - 1):
        meets = (
            (lo[k + 1 :] <= hi[k]).all(axis=1) & (hi[k + 1 :] >= lo[k]).all(axis=1)
        )
        px, py = caps[k]
        ex, ey = np.roll(px, -1) - px, np.roll(py, -1) - py
        for m in np.flatnonzero(meets) + k + 1:
            qx, qy = caps[m]
            fx, fy = np.roll(qx, -1) - qx, np.roll(qy, -1) - qy
            den = ex[:, None] * fy - ey[:, None] * fx
            wx, wy = qx - px[:, None], qy - py[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = (wx * fy - wy * fx) / den
                u = (wx * ey[:, None] - wy * ex[:, None]) / den
                ok = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
                found.append((px[:, None] + t * ex[:, None])[ok])
    return np.concatenate(found) if found else np.empty(0)


SLAB_BLOCK = 512


def _capsule_union(segments: np.ndarray, d: float) -> tuple:
    """Union of the capsules of (n, 4) segments, as trapezoids with disjoint interiors.

    Cutting at every outline vertex and crossing leaves slabs in which no two outlines cross. In a
    slab each capsule is an interval in y with straight ends, so the union is a merge of intervals.
    Returns ``(x0, x1, low0, low1, high0, high1)`` arrays, one entry per trapezoid.
    """
    segments = np.unique(segments, axis=0)
    caps = [_capsule(*s, d) for s in segments]
    chains = [_chains(*c) for c in caps]
    left = np.array([c[0].min() for c in caps])
    right = np.array([c[0].max() for c in caps])
    cuts = np.unique(np.concatenate([c[0] for c in caps] + [_crossing_xs(caps)]))
    out = []
    for begin in range(0, len(cuts) - 1, SLAB_BLOCK):
        xs = cuts[begin : begin + SLAB_BLOCK + 1]
        live = np.flatnonzero((left < xs[-1]) & (right > xs[0]))
        if not len(live):
            continue
        low = np.array([np.interp(xs, *chains[c][0]) for c in live])
        high = np.array([np.interp(xs, *chains[c][1]) for c in live])
        mid = (xs[:-1] + xs[1:]) / 2
        active = (left[live][:, None] < mid) & (right[live][:, None] > mid)
        low_mid = np.where(active, (low[:, :-1] + low[:, 1:]) / 2, np.inf)
        high_mid = np.where(active, (high[:, :-1] + high[:, 1:]) / 2, -np.inf)
        order = np.argsort(low_mid, axis=0)
        low_mid = np.take_along_axis(low_mid, order, 0)
        high_mid = np.take_along_axis(high_mid, order, 0)
        reach = np.maximum.accumulate(high_mid, axis=0)
        # capsule holding the highest end so far
        top = np.where(high_mid >= reach, np.arange(len(live))[:, None], 0)
        top = np.maximum.accumulate(top, axis=0)
        on = np.isfinite(low_mid)
        opens = on.copy()
        opens[1:] &= low_mid[1:] > reach[:-1]
        closes = on.copy()
        closes[:-1] &= opens[1:] | ~on[1:]
        slab, k = np.nonzero(opens.T)
        slab_end, k_end = np.nonzero(closes.T)
        bottom = order[k, slab]
        upper = order[top[k_end, slab_end], slab]
        out.append(
            (
                xs[slab], xs[slab + 1],
                low[bottom, slab], low[bottom, slab + 1],
                high[upper, slab], high[upper, slab + 1],
            )
        )
    return tuple(np.concatenate(c) for c in zip(*out))


def buffer(b: Batch, d: float) -> pa.Array:
    """Buffer of points and lines; see ``st_buffer``."""
    if np.isin(b.kind, AREAL).any():
        raise ValueError("st_buffer takes points and lines")
    outline = Outline.of(b)
    part_count = np.zeros(len(b), np.int64)
    kind = np.full(len(b), MULTIPOLYGON)
    sizes, xs, ys = [], [], []
    for row in np.flatnonzero((outline.count > 0) & (d > 0)):
        seg = slice(outline.start[row], outline.start[row] + outline.count[row])
        segments = np.column_stack(
            [outline.ax[seg], outline.ay[seg], outline.bx[seg], outline.by[seg]]
        )
        if len(segments) == 1:  # one convex outline needs no cutting
            x, y = _capsule(*segments[0], d)
            kind[row], part_count[row] = POLYGON, 1
            sizes.append([len(x) + 1])
            xs.append(np.append(x, x[0]))
            ys.append(np.append(y, y[0]))
            continue
        x0, x1, low0, low1, high0, high1 = _capsule_union(segments, d)
        part_count[row] = len(x0)
        sizes.append(np.full(len(x0), 5))
        xs.append(np.column_stack([x0, x1, x1, x0, x0]).ravel())
        ys.append(np.column_stack([low0, low1, high1, high0, low0]).ravel())
    flat = [np.concatenate(v) if v else np.empty(0) for v in (sizes, xs, ys)]
    return to_arrow(kind, part_count, flat[0].astype(np.int64), flat[1], flat[2], ~b.valid)


# ---------------------------------------------------------------- well-known binary

# Fixed values of the well-known binary format.
WKB_CODE = {POINT: 1, LINESTRING: 2, POLYGON: 3, MULTIPOLYGON: 6, MULTIPOINT: 4, MULTILINESTRING: 5}
WKB_MEMBER = {MULTIPOLYGON: 3, MULTIPOINT: 1, MULTILINESTRING: 2}  # what the members of a collection are
LITTLE_ENDIAN = 1
WITH_Z, WITH_M, WITH_SRID = 0x80000000, 0x40000000, 0x20000000  # flags of the extended form
ISO_STEP = 1000  # type + 1000 has z, + 2000 m, + 3000 both


def _put_u32(out: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    out[at[:, None] + np.arange(4)] = value.astype("<u4").view(np.uint8).reshape(-1, 4)


def to_wkb(b: Batch) -> pa.Array:
    """Little-endian well-known binary. An empty point has NaN coordinates."""
    total = b.vertex_counts()
    if ((b.kind == POINT) & (total == 0) & b.valid).any():
        b = _with_nan_points(b, (b.kind == POINT) & (total == 0) & b.valid)
        total = b.vertex_counts()
    kind = np.maximum(b.kind, 0)
    head = np.array([5, 9, 9, 9, 9, 9])[kind]  # byte order, type, and a count except for points
    part_head = np.array([0, 0, 4, 13, 5, 9])[kind]  # ring size; a member has its own head
    length = np.where(b.valid, head + part_head * b.part_count + 16 * total, 0)
    start = starts_of(length)
    out = np.zeros(int(length.sum()), np.uint8)

    rows = np.flatnonzero(b.valid)
    out[start[rows]] = LITTLE_ENDIAN
    _put_u32(out, start[rows] + 1, np.array([WKB_CODE[k] for k in range(len(KINDS))])[kind[rows]])
    counted = rows[kind[rows] != POINT]
    number = np.where(kind == LINESTRING, total, b.part_count)
    _put_u32(out, start[counted] + 5, number[counted])

    part_row = b.part_rows()
    part_length = part_head[part_row] + 16 * b.size
    before = starts_of(part_length)
    first_part = starts_of(b.part_count)
    row_first = np.append(before, 0)[np.minimum(first_part, len(before))]
    part_at = (start + head)[part_row] + before - row_first[part_row]
    ring = np.flatnonzero(kind[part_row] == POLYGON)
    _put_u32(out, part_at[ring], b.size[ring])
    for of, member in WKB_MEMBER.items():
        nested = np.flatnonzero(kind[part_row] == of)
        out[part_at[nested]] = LITTLE_ENDIAN
        _put_u32(out, part_at[nested] + 1, np.full(len(nested), member))
        if of == MULTIPOLYGON:
            _put_u32(out, part_at[nested] + 5, np.ones(len(nested)))
        if of != MULTIPOINT:
            _put_u32(out, part_at[nested] + part_head[part_row[nested]] - 4, b.size[nested])

    step = np.arange(len(b.x)) - np.repeat(starts_of(b.size), b.size)
    at = np.repeat(part_at + part_head[part_row], b.size) + 16 * step
    pairs = np.column_stack([b.x, b.y]).astype("<f8")
    out[at[:, None] + np.arange(16)] = pairs.view(np.uint8).reshape(-1, 16)

    return pa.Array.from_buffers(
        pa.large_binary(),
        len(b),
        [
            pa.array(b.valid).buffers()[1],
            pa.py_buffer(np.append(start, length.sum()).astype(np.int64)),
            pa.py_buffer(out),
        ],
    ).cast(pa.binary())


def _with_nan_points(b: Batch, rows: np.ndarray) -> Batch:
    """Give the empty points one NaN vertex, the form the binary format has for them."""
    count = np.where(rows, 1, b.part_count)
    old = np.repeat(~rows, count)
    size = np.ones(int(count.sum()), np.int64)
    size[old] = b.size[np.repeat(~rows, b.part_count)]
    keep = np.repeat(old, size)
    x, y = np.full(len(keep), np.nan), np.full(len(keep), np.nan)
    x[keep], y[keep] = b.x, b.y
    return Batch(b.valid, b.kind, count, size, x, y)


class _Wkb:
    """The bytes of a column of binary geometries, read at many places at a time."""

    def __init__(self, arr: pa.Array):
        arr = arr.cast(pa.large_binary())
        offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
        held = arr.buffers()[2]
        self.raw = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        self.start, self.end = offsets[:-1], offsets[1:]

    def bytes_at(self, pos: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        if (pos + n > self.end[rows]).any():
            raise ValueError("a well-known binary ends too early")
        return self.raw[pos[:, None] + np.arange(n)]

    def number(self, pos: np.ndarray, little: np.ndarray, rows: np.ndarray) -> np.ndarray:
        b = self.bytes_at(pos, 4, rows)
        return np.where(little, b.view("<u4")[:, 0], b.view(">u4")[:, 0]).astype(np.int64)

    def heads(self, pos: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Type, coordinates of a vertex, byte order, and the place after the head, in plain, ISO or extended form."""
        little = self.bytes_at(pos, 1, rows)[:, 0] == LITTLE_ENDIAN
        code = self.number(pos + 1, little, rows)
        plain = code & 0x1FFFFFFF
        more = plain // ISO_STEP
        dims = 2 + np.where(more > 0, np.array([0, 1, 1, 2])[np.minimum(more, 3)], ((code & WITH_Z) > 0) * 1 + ((code & WITH_M) > 0))
        kind = plain % ISO_STEP
        if ((kind < 1) | (kind > 6) | (more > 3)).any():
            bad = code[(kind < 1) | (kind > 6) | (more > 3)][0]
            raise ValueError(f"unsupported geometry type in well-known binary: {bad}")
        return kind, dims, little, pos + 5 + np.where(code & WITH_SRID, 4, 0)


def from_wkb(arr: pa.Array) -> pa.Array:
    """Geometries from well-known binary of either byte order, with or without z, m and a reference system, of which x
    and y are kept.

    All rows are read together: first their heads, then the first part of every row, the second parts, and so on.
    """
    data = _Wkb(arr)
    rows = np.flatnonzero(arr.is_valid().to_numpy(zero_copy_only=False))
    code, dims, little, pos = data.heads(data.start[rows].copy(), rows)
    left = np.ones(len(rows), np.int64)
    many = code > 2
    left[many] = data.number(pos[many], little[many], rows[many])
    pos[many] += 4

    found: list[tuple] = []  # row, start, vertices, coordinates of a vertex, byte order, whether a point
    going = np.flatnonzero(left > 0)
    while len(going):
        row, at = rows[going], pos[going]
        kind, d, order = code[going].copy(), dims[going].copy(), little[going].copy()
        member = kind > 3
        if member.any():
            kind[member], d[member], order[member], at[member] = data.heads(at[member], row[member])
        counted = kind != 1
        rings = member & (kind == 3)
        if rings.any():
            if (data.number(at[rings], order[rings], row[rings]) != 1).any():
                raise ValueError("a multipolygon with holes is not supported")
            at[rings] += 4
        size = np.ones(len(going), np.int64)
        size[counted] = data.number(at[counted], order[counted], row[counted])
        at = at + np.where(counted, 4, 0)
        after = at + 8 * d * size
        if (after > data.end[row]).any():
            raise ValueError("a well-known binary ends too early")
        found.append((row, at, size, d, order, ~counted))
        pos[going] = after
        left[going] -= 1
        going = going[left[going] > 0]

    row, start, size, d, order, point = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 6
    placed = np.argsort(row, kind="stable")
    row, start, size, d, order, point = (c[placed] for c in (row, start, size, d, order, point.astype(bool)))
    each = np.repeat(start, size) + 8 * np.repeat(d, size) * runs(np.zeros(len(size), np.int64), size)
    xy = np.ascontiguousarray(data.raw[each[:, None] + np.arange(16)]) if len(each) else np.zeros((0, 16), np.uint8)
    little_xy = np.repeat(order.astype(bool), size)[:, None]
    xy = np.where(little_xy, xy.view("<f8"), xy.view(">f8"))

    # an empty point has coordinates that are no numbers, an empty line has no vertices: neither has a part
    top = np.zeros(len(arr), np.int64)
    top[rows] = code
    blank = np.zeros(len(size), bool)
    blank[point] = np.isnan(xy[starts_of(size)[point]]).all(axis=1)
    keep = ~(blank | ((top[row] == 2) & (size == 0)))
    xy = xy[np.repeat(keep, size)]
    of_code = np.zeros(7, np.int64)
    of_code[list(WKB_CODE.values())] = list(WKB_CODE)
    kinds = np.full(len(arr), -1)
    kinds[rows] = of_code[code]
    part_count = np.bincount(row[keep], minlength=len(arr)).astype(np.int64)
    return to_arrow(kinds, part_count, size[keep], xy[:, 0], xy[:, 1], kinds < 0)
