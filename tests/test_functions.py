"""Golden values of the geometry functions."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadgeo import functions as G
from roadgeo.types import is_geometry

BENT = "LINESTRING(0 0,3 4,3 5)"
SQUARE = "POLYGON((0 0,2 0,2 2,0 2,0 0))"
RING_LINE = "LINESTRING(0 0,4 0,4 4,0 4,0 0)"
HOLED = "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,3 1,3 3,1 3,1 1))"


@pytest.fixture(scope="module")
def one(spark):
    return lambda *cols: spark.range(1).select(*cols).first()


def wkt(text):
    return G.st_geomfromwkt(text)


def texts(spark, *rows):
    return spark.createDataFrame([(t,) for t in rows], "t string").select(
        "t", G.st_geomfromwkt(F.col("t")).alias("g")
    )


def test_length_and_counts(one):
    row = one(
        G.st_length(wkt(BENT)),
        G.st_numpoints(wkt(BENT)),
        G.st_length(wkt("POINT(1 1)")),
        G.st_length(wkt(SQUARE)),
        G.st_length(wkt("LINESTRING EMPTY")),
        G.st_numpoints(wkt(SQUARE)),
        G.st_numpoints(wkt("LINESTRING EMPTY")),
    )
    assert tuple(row) == (6.0, 3, 0.0, 0.0, 0.0, None, 0)


@pytest.mark.parametrize(
    "text,envelope",
    [
        (BENT, "POLYGON ((0 0, 0 5, 3 5, 3 0, 0 0))"),
        ("LINESTRING(0 0,10 0)", "LINESTRING (0 0, 10 0)"),
        ("LINESTRING(0 0,0 0)", "POINT (0 0)"),
        ("LINESTRING EMPTY", None),
    ],
)
def test_envelope(one, text, envelope):
    assert one(G.st_astext(G.st_envelope(wkt(text))))[0] == envelope


@pytest.mark.parametrize(
    "text,x,y",
    [
        (BENT, 1.75, 2.4166666666666665),
        ("LINESTRING(0 0,10 0)", 5, 0),
        ("LINESTRING(0 0,0 0)", 0, 0),
        (RING_LINE, 2, 2),
        (SQUARE, 1, 1),
        ("POLYGON((0 0,0 2,2 2,2 0,0 0))", 1, 1),
        ("POLYGON((0 0,4 0,4 4,0 4,0 0),(2 2,4 2,4 4,2 4,2 2))", 20 / 12, 20 / 12),
        ("POLYGON((0 0,2 0,2 0,0 0))", 1, 0),
        ("POINT(3 4)", 3, 4),
        ("MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0)),((4 0,6 0,6 2,4 2,4 0)))", 3, 1),
    ],
)
def test_centroid(one, text, x, y):
    c = G.st_centroid(wkt(text))
    assert tuple(one(G.st_x(c), G.st_y(c))) == pytest.approx((x, y), rel=1e-14)


def test_area(one):
    row = one(*[G.st_area(wkt(t)) for t in (SQUARE, HOLED, RING_LINE, "POINT(1 1)")])
    assert tuple(row) == (4.0, 12.0, 0.0, 0.0)


def test_end_points(one):
    row = one(
        G.st_astext(G.st_startpoint(wkt(BENT))),
        G.st_astext(G.st_endpoint(wkt(BENT))),
        G.st_startpoint(wkt(SQUARE)),
        G.st_endpoint(wkt("LINESTRING EMPTY")),
    )
    assert tuple(row) == ("POINT (0 0)", "POINT (3 5)", None, None)


def test_null_in_null_out(spark):
    df = texts(spark, None)
    row = df.select(
        G.st_length("g"), G.st_area("g"), G.st_numpoints("g"), G.st_envelope("g"),
        G.st_centroid("g"), G.st_startpoint("g"), G.st_astext("g"), G.st_aswkb("g"),
        G.st_buffer("g", 1.0), G.st_distance("g", "g"), G.st_intersects("g", "g"),
        G.st_point(F.lit(None).cast("double"), F.lit(1.0)),
    ).first()
    assert all(v is None for v in row)


def test_make_line(spark):
    def line(*points):
        return G.st_makeline(F.array(*[G.st_point(F.lit(x), F.lit(y)) for x, y in points]))

    row = spark.range(1).select(G.st_astext(line((0, 0), (1, 2), (0, 0)))).first()
    assert row[0] == "LINESTRING (0 0, 1 2, 0 0)"
    with pytest.raises(PySparkException, match="at least two"):
        spark.range(1).select(line((0, 0))).collect()


@pytest.mark.parametrize(
    "text,d,area",
    [
        (BENT, 1.0, 15.107400730799608),
        ("LINESTRING(0 0,10 0)", 1.0, 23.121445152258055),
        ("POINT(0 0)", 1.0, 3.121445152258052),
        ("LINESTRING(0 0,0 0)", 1.0, 3.121445152258052),
        (RING_LINE, 1.0, 31.121445152258048),
        ("LINESTRING(0 0,1 0)", 0.0, 0.0),
        ("LINESTRING(0 0,1 0)", -1.0, 0.0),
    ],
)
def test_buffer_area(one, text, d, area):
    got = one(G.st_area(G.st_buffer(wkt(text), d)))[0]
    assert got == pytest.approx(area, rel=2e-3 if text == BENT else 1e-12)


def test_buffer_of_two_vertex_line_is_exact(one):
    length, d = math.hypot(3, 4), 0.7
    got = one(G.st_area(G.st_buffer(wkt("LINESTRING(1 1,4 5)"), d)))[0]
    assert got == pytest.approx(2 * d * length + 16 * math.sin(math.pi / 16) * d * d, rel=1e-12)


def test_point_buffer_has_a_closed_32_gon(one):
    parts = one(G.st_buffer(wkt("POINT(0 0)"), 1.0).alias("g"))["g"]["parts"]
    assert len(parts) == 1 and len(parts[0]) == 33 and parts[0][0] == parts[0][-1]


PAIRS = [
    (SQUARE, "LINESTRING(-1 1,3 1)", True, 0),
    (SQUARE, "LINESTRING(2 2,3 3)", True, 0),
    (SQUARE, "LINESTRING(0.5 0.5,1 1)", True, 0),
    (SQUARE, "LINESTRING(3 0,3 3)", False, 1),
    (SQUARE, "LINESTRING(-1 2.5,2.5 -1)", True, 0),
    ("LINESTRING(0 0,2 2)", "LINESTRING(0 2,2 0)", True, 0),
    ("LINESTRING(0 0,1 0)", "LINESTRING(2 1,3 1)", False, math.sqrt(2)),
    (HOLED, "POINT(2 2)", False, 1),
    (HOLED, "POINT(0.5 2)", True, 0),
    (HOLED, "LINESTRING(1 2,3 2)", True, 0),
    ("POINT(0 0)", "POINT(3 4)", False, 5),
    ("POINT(1 1)", "POINT(1 1)", True, 0),
    ("LINESTRING(0 0,4 0)", "LINESTRING(2 0,6 0)", True, 0),
    ("LINESTRING(0 0,1 0)", "LINESTRING(2 0,3 0)", False, 1),
    ("LINESTRING(0 0,1 0)", "LINESTRING EMPTY", False, None),
]


def test_intersects_and_distance(spark):
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b, _, _) in enumerate(PAIRS)], "i int, a string, b string"
    ).select("i", *[G.st_geomfromwkt(F.col(c)).alias(c) for c in "ab"])
    rows = df.select(
        "i",
        G.st_intersects("a", "b").alias("ab"), G.st_intersects("b", "a").alias("ba"),
        G.st_distance("a", "b").alias("dab"), G.st_distance("b", "a").alias("dba"),
    ).collect()
    for r in rows:
        _, _, meets, gap = PAIRS[r["i"]]
        assert (r["ab"], r["ba"]) == (meets, meets), PAIRS[r["i"]]
        for got in (r["dab"], r["dba"]):
            assert got is None if gap is None else got == pytest.approx(gap, abs=1e-15)


def test_constant_geometry_agrees_with_column(spark):
    df = texts(spark, *[b for _, b, _, _ in PAIRS[:5]], None)
    rows = df.select(
        G.st_intersects("g", wkt=SQUARE), G.st_intersects("g", wkt(SQUARE)),
        G.st_distance("g", wkt=SQUARE), G.st_distance("g", wkt(SQUARE)),
    ).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)


SHAPES = [
    "POINT (1 2)", "LINESTRING (0 0, 3 4, 3 5)", "LINESTRING EMPTY", "POINT EMPTY",
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))",
    "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((4 0, 6 0, 6 2, 4 0)))",
    "POLYGON EMPTY", "POINT (-0.5 0.00001)", "LINESTRING (15.900001 45.8, -1.25 1000000000)",
]


def test_text_and_binary_round_trips(spark):
    df = texts(spark, *SHAPES, None)
    back = df.select(
        "t", G.st_astext("g").alias("text"), "g", G.st_geomfromwkb(G.st_aswkb("g")).alias("w")
    ).collect()
    assert all(r["g"] == r["w"] for r in back)
    plain = {r["t"]: r["text"] for r in back}
    assert all(plain[t] == t for t in SHAPES[:7])


def test_wkb_bytes(one):
    golden = bytes.fromhex("0101000000000000000000F03F0000000000000040")
    big = bytes.fromhex("00000000013FF00000000000004000000000000000")
    assert one(G.st_aswkb(wkt("POINT(1 2)")))[0] == golden
    for raw in (golden, big):
        assert one(G.st_astext(G.st_geomfromwkb(F.lit(raw))))[0] == "POINT (1 2)"


@pytest.mark.parametrize(
    "bad", ["", "POINT(1)", "LINESTRING(0 0)", "POLYGON((0 0,1 0,1 1))", "CIRCLE(0 0)", "POINT(a b)"]
)
def test_bad_text_is_an_error(spark, bad):
    with pytest.raises(ValueError):
        G.st_geomfromwkt(bad)
    with pytest.raises(PySparkException, match="not a geometry text"):
        texts(spark, bad).collect()


def test_geometry_type_is_recognised(spark):
    df = texts(spark, "POINT(1 2)").select(
        "t", G.st_point(F.lit(1), F.lit(2)).alias("p"), G.st_envelope("g").alias("e")
    )
    assert [is_geometry(f.dataType) for f in df.schema.fields] == [False, True, True]


def test_file_names(spark):
    names = {
        "a.osm.pbf": ("a", "a.osm"), "/x/y.z/a.osm": ("a", None), ".bashrc": (".bashrc", ".bashrc"),
        "plain": ("plain", "plain"), "my track.gpx": ("my track", "my track"),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", G.file_stem("n").alias("s"), G.without_last_suffix("n").alias("l")).collect():
        stem, last = names[r["n"]]
        assert r["s"] == stem
        assert last is None or r["l"] == last


@pytest.mark.parametrize(
    "text,length", [("MULTIPOINT ((1 2), (3 4))", 0.0), ("MULTILINESTRING ((0 0, 3 4), (1 1, 1 2, 1 3))", 7.0), ("MULTIPOINT EMPTY", 0.0), ("MULTILINESTRING EMPTY", 0.0)]
)
def test_multi_types(one, text, length):
    shape = G.st_geomfromwkt(F.lit(text))
    assert one(G.st_astext(shape))[0] == one(G.st_astext(G.st_geomfromwkb(G.st_aswkb(shape))))[0] == text
    assert one(G.st_length(shape))[0] == length and one(G.st_area(shape))[0] == 0.0
    assert one(G.st_astext(G.st_geomfromwkt(text)))[0] == text
