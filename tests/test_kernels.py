"""Properties of the geometry kernels, and a cross-check with the geometry library Spark ships."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadgeo.functions import kernels as K

coordinate = st.integers(-50, 50).map(lambda n: n / 8)
vertex = st.tuples(coordinate, coordinate)
line = st.lists(vertex, min_size=2, max_size=7)


def arrow(*shapes):
    rows = [
        {"type": kind, "parts": [[{"x": x, "y": y} for x, y in part] for part in parts]}
        for kind, parts in shapes
    ]
    return pa.array(rows, K.ARROW_GEOMETRY)


def lines(*paths):
    return K.Outline.of(K.Batch.of(arrow(*[("LINESTRING", [p]) for p in paths])))


def text(path):
    return "LINESTRING(" + ",".join(f"{x} {y}" for x, y in path) + ")"


@settings(max_examples=200, deadline=None)
@given(line, line)
def test_distance_is_symmetric_and_zero_where_they_meet(p, q):
    a, b = lines(p), lines(q)
    d, e = K.distance(a, b)[0], K.distance(b, a)[0]
    assert d == pytest.approx(e, rel=1e-12)
    assert (d == 0) == bool(K.intersects(a, b)[0])
    shortest = min(math.dist(v, w) for v in p for w in q)
    assert d <= shortest * (1 + 1e-12)


@settings(max_examples=100, deadline=None)
@given(line, st.sampled_from([0.25, 1.0, 3.0]))
def test_buffer_area_bounds(p, d):
    out = K.buffer(K.Batch.of(arrow(("LINESTRING", [p]))), d)
    parts = out.to_pylist()[0]["parts"]
    area = 0.0
    for ring in parts:
        xy = np.array([(v["x"], v["y"]) for v in ring])
        x, y = xy[:, 0] - xy[0, 0], xy[:, 1] - xy[0, 1]
        area += abs(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1])) / 2
    length = sum(math.dist(v, w) for v, w in zip(p, p[1:]))
    cap = 16 * math.sin(math.pi / 16) * d * d
    assert area <= 2 * d * length + cap * len(p) + 1e-9
    straight = max(math.dist(v, w) for v in p for w in p)
    assert area >= 2 * d * straight * 0.95 * math.cos(math.pi / 16) + 0.95 * cap - 1e-9


def test_two_blocks_give_the_same_distance(monkeypatch):
    rng = np.random.default_rng(3)
    paths = [[tuple(v) for v in rng.normal(size=(n, 2))] for n in (2, 40, 3, 25)]
    a, b = lines(*paths), lines(*paths[::-1])
    whole = K.distance(a, b), K.intersects(a, b)
    monkeypatch.setattr(K, "PAIR_BLOCK", 7)
    np.testing.assert_array_equal(K.distance(a, b), whole[0])
    np.testing.assert_array_equal(K.intersects(a, b), whole[1])


def test_nearly_collinear_turns_are_exact():
    o, p = (0.1, 0.1), (0.3, 0.3)
    for q in ((0.7, 0.7), (0.7, np.nextafter(0.7, 1)), (0.7, np.nextafter(0.7, 0))):
        got = K.turn(*[np.array([c]) for c in (*o, *p, *q)])[0]
        # points on x = y are exactly collinear; one ulp above or below is not
        assert got == int(q[1] > q[0]) - int(q[1] < q[0])


def test_slices_and_nulls():
    shapes = arrow(
        ("LINESTRING", [[(0, 0), (3, 4)]]), ("POINT", [[(1, 1)]]), ("LINESTRING", [[(0, 0), (1, 0), (1, 1)]])
    )
    with_null = pa.array([None, *shapes.to_pylist(), None], K.ARROW_GEOMETRY)
    part = K.Batch.of(with_null.slice(2, 3))
    assert part.valid.tolist() == [True, True, False]
    assert part.vertex_counts().tolist() == [1, 3, 0]
    back = K.from_wkb(K.to_wkb(K.Batch.of(with_null.slice(1))))
    assert back.to_pylist() == with_null.slice(1).to_pylist()


def test_long_line_buffer_in_blocks(monkeypatch):
    path = [(i * 0.37, math.sin(i * 0.5)) for i in range(60)]
    b = K.Batch.of(arrow(("LINESTRING", [path])))

    def area():
        x0, x1, l0, l1, h0, h1 = K._capsule_union(
            np.array([(*p, *q) for p, q in zip(path, path[1:])]), 0.3
        )
        return float(np.sum((x1 - x0) * ((h0 - l0) + (h1 - l1)) / 2))

    whole = area()
    monkeypatch.setattr(K, "SLAB_BLOCK", 5)
    assert area() == pytest.approx(whole, rel=1e-12)
    assert len(K.buffer(b, 0.3)) == 1


# ---------------------------------------------------------------- cross-check


@pytest.fixture(scope="module")
def jts(spark):
    """Reader of the geometry library among Spark's own jars; used by tests only."""
    try:
        return spark._jvm.org.locationtech.jts.io.WKTReader()
    except Exception:
        pytest.skip("no geometry library on the class path")


def random_paths(n, seed):
    rng = np.random.default_rng(seed)
    return [
        [tuple(np.round(v, 3)) for v in np.cumsum(rng.normal(size=(rng.integers(2, 9), 2)), axis=0)]
        for _ in range(n)
    ]


def test_distance_and_intersection_against_the_library(jts):
    a, b = random_paths(60, 1), random_paths(60, 2)
    d, hit = K.distance(lines(*a), lines(*b)), K.intersects(lines(*a), lines(*b))
    for k in range(60):
        g, h = jts.read(text(a[k])), jts.read(text(b[k]))
        assert d[k] == pytest.approx(g.distance(h), rel=1e-12, abs=1e-15)
        assert hit[k] == g.intersects(h)


def test_polygons_against_the_library(jts):
    rings, others = [], random_paths(40, 5)
    rng = np.random.default_rng(4)
    for _ in range(40):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 7))
        r = rng.uniform(0.5, 2, 7)
        ring = [(float(round(a, 3)), float(round(b, 3))) for a, b in zip(r * np.cos(turn), r * np.sin(turn))]
        rings.append([*ring, ring[0]])
    p = K.Outline.of(K.Batch.of(arrow(*[("POLYGON", [r]) for r in rings])))
    d, hit = K.distance(p, lines(*others)), K.intersects(lines(*others), p)
    for k in range(40):
        g = jts.read("POLYGON((" + text(rings[k])[len("LINESTRING("):] + ")")
        h = jts.read(text(others[k]))
        assert d[k] == pytest.approx(g.distance(h), rel=1e-12, abs=1e-15)
        assert hit[k] == g.intersects(h)


def test_buffer_area_against_the_library(jts):
    paths = random_paths(40, 7)
    out = K.buffer(K.Batch.of(arrow(*[("LINESTRING", [p]) for p in paths])), 0.4).to_pylist()
    for path, got in zip(paths, out):
        area = 0.0
        for ring in got["parts"]:
            xy = np.array([(v["x"], v["y"]) for v in ring])
            area += abs(np.sum(xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1])) / 2
        assert area == pytest.approx(jts.read(text(path)).buffer(0.4).getArea(), rel=4e-3)


SHAPES = [
    ("POINT", [[(1.5, -2.0)]]), ("LINESTRING", [[(0.0, 0.0), (3.0, 4.0)]]),
    ("POLYGON", [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]),
    ("MULTIPOINT", [[(1.0, 2.0)], [(3.0, 4.0)]]), ("MULTILINESTRING", [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (7.0, 8.0)]]),
    ("MULTIPOLYGON", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]),
    ("POINT", []), ("LINESTRING", []), ("POLYGON", []), ("MULTIPOINT", []), ("MULTILINESTRING", []), ("MULTIPOLYGON", []),
]


def plain_wkb(kind, parts, order, form, extra):
    """One geometry at a time: `form` is plain, iso or extended; `extra` further coordinates of each vertex."""
    base = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}

    def head(code, outer):
        if form == "iso":
            code += 1000 * extra
        if form == "extended":
            code |= (0x80000000 if extra else 0) | (0x20000000 if outer else 0)
        srid = struct.pack(order + "I", 4326) if form == "extended" and outer else b""
        return bytes([order == "<"]) + struct.pack(order + "I", code) + srid

    def vertices(path):
        return b"".join(struct.pack(order + "2d", *p) + struct.pack(order + "d", 7.0) * extra for p in path)

    def counted(path):
        return struct.pack(order + "I", len(path)) + vertices(path)

    out = head(base[kind], True)
    if kind == "POINT":
        return out + vertices(parts[0] if parts else [(math.nan, math.nan)])
    if kind == "LINESTRING":
        return out + counted(parts[0] if parts else [])
    out += struct.pack(order + "I", len(parts))
    if kind == "POLYGON":
        return out + b"".join(map(counted, parts))
    if kind == "MULTIPOINT":
        return out + b"".join(head(1, False) + vertices(p) for p in parts)
    if kind == "MULTILINESTRING":
        return out + b"".join(head(2, False) + counted(p) for p in parts)
    return out + b"".join(head(3, False) + struct.pack(order + "I", 1) + counted(p) for p in parts)


def shape_array(shapes):
    rows = [None if s is None else {"type": s[0], "parts": [[{"x": x, "y": y} for x, y in p] for p in s[1]]} for s in shapes]
    return pa.array(rows, K.ARROW_GEOMETRY)


def test_wkb_forms_in_one_column():
    forms = [(o, f, e) for o in "<>" for f in ("plain", "iso", "extended") for e in (0, 1) if f != "plain" or not e]
    coded = [(s, plain_wkb(*s, *f)) for s in SHAPES for f in forms] + [(None, None)]
    random.Random(5).shuffle(coded)
    data = pa.array([c for _, c in coded], pa.binary())
    assert K.from_wkb(data).to_pylist() == shape_array([s for s, _ in coded]).to_pylist()
    assert K.from_wkb(data.slice(7, 20)).to_pylist() == shape_array([s for s, _ in coded[7:27]]).to_pylist()


def test_wkb_of_all_types_is_plain():
    got = K.to_wkb(K.Batch.of(shape_array(SHAPES))).to_pylist()
    want = [plain_wkb(*s, "<", "plain", 0) for s in SHAPES]
    assert [g for g, s in zip(got, SHAPES) if s != ("POINT", [])] == [w for w, s in zip(want, SHAPES) if s != ("POINT", [])]
    assert len(K.from_wkb(pa.array([], pa.binary()))) == 0


@pytest.mark.parametrize("bad", [b"\x01\x07\x00\x00\x00\x00\x00\x00\x00", b"\x01\x02\x00\x00\x00\xff\xff\xff\x0f", b"\x01\x01\x00"])
def test_bad_wkb_is_an_error(bad):
    with pytest.raises(ValueError, match="well-known binary"):
        K.from_wkb(pa.array([bad], pa.binary()))


def test_multi_types_in_other_kernels():
    lines = shape_array([SHAPES[4], SHAPES[3]])
    point = shape_array([("POINT", [[(6.0, 5.0)]]), ("POINT", [[(3.0, 5.0)]])])
    a, b = K.Outline.of(K.Batch.of(lines)), K.Outline.of(K.Batch.of(point))
    assert K.distance(a, b).tolist() == [0.0, 1.0] and K.intersects(a, b).tolist() == [True, False]
