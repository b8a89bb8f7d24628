"""Geometry functions written as Catalyst expressions: ``Column -> Column``, no Python workers.

NULL gives NULL. An empty geometry has length 0, area 0 and no vertices, and gives NULL for the
envelope, the centroid and the end points.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT, LINESTRING, POLYGON, MULTIPOLYGON = "POINT", "LINESTRING", "POLYGON", "MULTIPOLYGON"
MULTIPOINT, MULTILINESTRING = "MULTIPOINT", "MULTILINESTRING"

# ---------------------------------------------------------------- building blocks


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(f):
    """Give the result column the function's name instead of its whole expression text."""

    @functools.wraps(f)
    def call(*args, **kwargs) -> Column:
        return f(*args, **kwargs).alias(f.__name__)

    return call


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts"))


def line_from_vertices(vertices: Column) -> Column:
    """Line through an array of (x, y) structs."""
    return geometry(LINESTRING, F.array(vertices))


def _first_part(g: Column) -> Column:
    return F.get(g["parts"], F.lit(0))


def _is_line(g: Column) -> Column:
    return g["type"] == LINESTRING


def _line_vertices(g: Column) -> Column:
    """Vertices of a line; NULL for every other geometry."""
    return F.when(_is_line(g), _first_part(g))


def _over_segments(v: Column, f) -> Column:
    """Array of ``f(p, q)`` over the consecutive vertex pairs of ``v``."""
    n = F.greatest(F.array_size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), f)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, d: acc + d)


def _segment_length(p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.sqrt(dx * dx + dy * dy)


def _weighted_sum(items: Column) -> Column:
    """Sum of (w, wx, wy) structs."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"))
    return F.aggregate(
        items,
        zero,
        lambda acc, i: F.struct(
            (acc["w"] + i["w"]).alias("w"),
            (acc["wx"] + i["wx"]).alias("wx"),
            (acc["wy"] + i["wy"]).alias("wy"),
        ),
    )


def _weighted(w: Column, x: Column, y: Column) -> Column:
    return F.struct(w.alias("w"), (w * x).alias("wx"), (w * y).alias("wy"))


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# ---------------------------------------------------------------- constructors


@named
def st_point(x: Column | str, y: Column | str) -> Column:
    """Point; NULL when either coordinate is NULL."""
    x, y = _col(x), _col(y)
    return F.when(
        x.isNotNull() & y.isNotNull(), geometry(POINT, F.array(F.array(vertex(x, y))))
    )


@named
def st_makeline(points: Column | str) -> Column:
    """Line through an array of points in array order; NULL points are passed over.

    A line has no vertex or at least two; a single one is an error.
    """
    points = _col(points)
    vertices = F.flatten(
        F.transform(F.filter(points, lambda p: p.isNotNull()), lambda p: p["parts"])
    )
    v = F.flatten(vertices)
    return (
        F.when(points.isNull(), F.lit(None))
        .when(F.array_size(v) == 1, F.raise_error(F.lit("a line needs no vertex or at least two")))
        .when(F.array_size(v) == 0, geometry(LINESTRING, F.slice(F.array(v), F.lit(1), F.lit(0))))
        .otherwise(line_from_vertices(v))
    )


# ---------------------------------------------------------------- measures


@named
def st_length(g: Column | str) -> Column:
    """Planar length of a line or of several; 0 for points and polygons."""
    g = _col(g)
    v = _first_part(g)
    lengths = F.transform(g["parts"], lambda part: _total(_over_segments(part, _segment_length)))
    return (
        F.when(g.isNull(), F.lit(None).cast("double"))
        .when(_is_line(g) & v.isNotNull(), _total(_over_segments(v, _segment_length)))
        .when(g["type"] == MULTILINESTRING, _total(lengths))
        .otherwise(F.lit(0.0))
    )


@named
def st_numpoints(g: Column | str) -> Column:
    """Number of vertices of a line; NULL for other geometries."""
    g = _col(g)
    return F.when(_is_line(g), F.coalesce(F.array_size(_first_part(g)), F.lit(0)))


def _ring_doubled_area(ring: Column) -> Column:
    """Twice the signed area of a ring, taken about its first vertex to keep digits."""
    return _let(
        F.get(ring, F.lit(0)),
        lambda o: _total(
            _over_segments(
                ring,
                lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"])
                - (q["x"] - o["x"]) * (p["y"] - o["y"]),
            )
        ),
    )


def _part_sign(g: Column, i: Column) -> Column:
    """-1 for the holes of a polygon, 1 for shells."""
    return F.when((g["type"] == POLYGON) & (i > 0), F.lit(-1.0)).otherwise(F.lit(1.0))


def _is_areal(g: Column) -> Column:
    return g["type"].isin(POLYGON, MULTIPOLYGON)


@named
def st_area(g: Column | str) -> Column:
    """Shells minus holes; 0 for points and lines."""
    g = _col(g)
    areas = F.transform(
        g["parts"], lambda ring: F.abs(_ring_doubled_area(ring)) / F.lit(2.0)
    )

    def combine(a: Column) -> Column:
        shell = F.coalesce(F.get(a, F.lit(0)), F.lit(0.0))
        return F.struct(_total(a).alias("all"), shell.alias("shell"))

    total = _let(areas, combine)
    return (
        F.when(g.isNull(), F.lit(None).cast("double"))
        .when(g["type"] == POLYGON, F.lit(2.0) * total["shell"] - total["all"])
        .when(g["type"] == MULTIPOLYGON, total["all"])
        .otherwise(F.lit(0.0))
    )


# ---------------------------------------------------------------- derived geometries


@named
def bbox(g: Column | str) -> Column:
    """STRUCT<xmin, ymin, xmax, ymax>; its fields are NULL for an empty geometry."""
    g = _col(g)
    v = F.flatten(g["parts"])
    xs = F.transform(v, lambda p: p["x"])
    ys = F.transform(v, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


@named
def st_envelope(g: Column | str) -> Column:
    """Bounding box: a polygon, or a line or point where the box has no width or height."""

    def shape(b: Column) -> Column:
        low = vertex(b["xmin"], b["ymin"])
        high = vertex(b["xmax"], b["ymax"])
        flat_x, flat_y = b["xmin"] == b["xmax"], b["ymin"] == b["ymax"]
        ring = F.array(
            low, vertex(b["xmin"], b["ymax"]), high, vertex(b["xmax"], b["ymin"]), low
        )
        return (
            F.when(b["xmin"].isNull(), F.lit(None))
            .when(flat_x & flat_y, geometry(POINT, F.array(F.array(low))))
            .when(flat_x | flat_y, geometry(LINESTRING, F.array(F.array(low, high))))
            .otherwise(geometry(POLYGON, F.array(ring)))
        )

    return _let(bbox(g), shape)


def _boundary_moments(g: Column) -> Column:
    """Length-weighted midpoints over the segments of all parts."""
    return _weighted_sum(
        F.flatten(
            F.transform(
                g["parts"],
                lambda part: _over_segments(
                    part,
                    lambda p, q: _weighted(
                        _segment_length(p, q),
                        (p["x"] + q["x"]) / F.lit(2.0),
                        (p["y"] + q["y"]) / F.lit(2.0),
                    ),
                ),
            )
        )
    )


def _vertex_moments(g: Column) -> Column:
    return _weighted_sum(
        F.transform(
            F.flatten(g["parts"]), lambda p: _weighted(F.lit(1.0), p["x"], p["y"])
        )
    )


def _ring_moments(ring: Column, sign: Column) -> Column:
    """Signed area moments of one ring: weight, and weight times centroid."""

    def about(o: Column) -> Column:
        sums = _weighted_sum(
            _over_segments(
                ring,
                lambda p, q: _weighted(
                    (p["x"] - o["x"]) * (q["y"] - o["y"])
                    - (q["x"] - o["x"]) * (p["y"] - o["y"]),
                    (p["x"] + q["x"] + o["x"]) / F.lit(3.0),
                    (p["y"] + q["y"] + o["y"]) / F.lit(3.0),
                ),
            )
        )
        return _let(
            sums,
            lambda s: F.struct(
                *[
                    (F.when(s["w"] < 0, -sign).otherwise(sign) * s[f]).alias(f)
                    for f in ("w", "wx", "wy")
                ]
            ),
        )

    return _let(F.get(ring, F.lit(0)), about)


def _area_moments(g: Column) -> Column:
    return _weighted_sum(
        F.transform(g["parts"], lambda ring, i: _ring_moments(ring, _part_sign(g, i)))
    )


@named
def st_centroid(g: Column | str) -> Column:
    """Centroid: by area for polygons, by length for lines, else the mean vertex.

    A polygon without area counts as its boundary, a line without length as its vertices.
    """
    nothing = F.struct(*[F.lit(0.0).alias(f) for f in ("w", "wx", "wy")])

    def point(m: Column) -> Column:
        return geometry(
            POINT, F.array(F.array(vertex(m["wx"] / m["w"], m["wy"] / m["w"])))
        )

    def of(g: Column) -> Column:
        by_area = F.when(_is_areal(g), _area_moments(g)).otherwise(nothing)
        by_length_or_vertex = _let(
            _boundary_moments(g),
            lambda b: F.when(b["w"] != 0, point(b)).otherwise(point(_vertex_moments(g))),
        )
        filled = g.isNotNull() & (F.array_size(F.flatten(g["parts"])) > 0)
        return F.when(
            filled,
            _let(by_area, lambda a: F.when(a["w"] != 0, point(a)).otherwise(by_length_or_vertex)),
        )

    return _let(_col(g), of)


def _end_point(g: Column | str, index: int) -> Column:
    v = _line_vertices(_col(g))
    return F.when(
        F.array_size(v) > 0, geometry(POINT, F.array(F.array(F.try_element_at(v, F.lit(index)))))
    )


@named
def st_startpoint(g: Column | str) -> Column:
    """First vertex of a line, else NULL."""
    return _end_point(g, 1)


@named
def st_endpoint(g: Column | str) -> Column:
    """Last vertex of a line, else NULL."""
    return _end_point(g, -1)


@named
def st_x(g: Column | str) -> Column:
    """x of a point."""
    g = _col(g)
    return F.when(g["type"] == POINT, F.get(_first_part(g), F.lit(0))["x"])


@named
def st_y(g: Column | str) -> Column:
    """y of a point."""
    g = _col(g)
    return F.when(g["type"] == POINT, F.get(_first_part(g), F.lit(0))["y"])


# ---------------------------------------------------------------- text form

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PAIR = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_PATH = rf"\s*\({_PAIR}(?:,{_PAIR})*\)\s*"
_LINE = rf"\s*\({_PAIR}(?:,{_PAIR})+\)\s*"
_RINGS = rf"\s*\({_PATH}(?:,{_PATH})*\)\s*"
_SHELLS = rf"\s*\(\s*\({_PATH}\)(?:\s*,\s*\({_PATH}\))*\s*\)\s*"
WKT_PATTERN = (
    rf"^\s*(?:POINT\s*\({_PAIR}\)\s*|LINESTRING{_LINE}|POLYGON{_RINGS}|MULTIPOLYGON{_SHELLS}"
    rf"|MULTIPOINT\s*\(\s*\({_PAIR}\)\s*(?:,\s*\({_PAIR}\)\s*)*\)\s*|MULTILINESTRING\s*\({_LINE}(?:,{_LINE})*\)\s*"
    r"|(?:MULTI)?(?:POINT|LINESTRING|POLYGON)\s+EMPTY\s*)$"
)
PART_PATTERN = r"\(([^()]+)\)"


def parse_wkt(text: str) -> tuple[str, list[list[tuple[float, float]]]]:
    """Parse one geometry text on the driver, for literal arguments."""
    if not re.match(WKT_PATTERN, text, re.IGNORECASE):
        raise ValueError(f"not a geometry text: {text!r}")
    parts = [
        [tuple(float(n) for n in pair.split()) for pair in part.split(",")]
        for part in re.findall(PART_PATTERN, text)
    ]
    kind = re.match(r"\s*(\w+)", text).group(1).upper()
    if kind in (POLYGON, MULTIPOLYGON) and any(len(r) < 4 or r[0] != r[-1] for r in parts):
        raise ValueError(f"ring is not closed: {text!r}")
    return kind, parts


def geometry_literal(kind: str, parts: list[list[tuple[float, float]]]) -> Column:
    """Literal geometry column; Catalyst folds it to a constant."""
    if not parts:
        some = F.array(F.array(vertex(F.lit(0.0), F.lit(0.0))))
        return geometry(kind, F.slice(some, 1, 0))
    return geometry(
        kind,
        F.array(*[F.array(*[vertex(F.lit(x), F.lit(y)) for x, y in part]) for part in parts]),
    )


@named
def st_geomfromwkt(text: Column | str) -> Column:
    """Geometry from text: a ``str`` is a constant and parsed once, a Column row by row.

    A text that is no geometry raises an error.
    """
    if isinstance(text, str):
        return geometry_literal(*parse_wkt(text))
    kind = F.upper(F.regexp_extract(text, r"^\s*(\w+)", 1))

    def pair(p: Column) -> Column:
        n = F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " ")
        return vertex(F.get(n, F.lit(0)), F.get(n, F.lit(1)))

    parts = F.transform(
        F.regexp_extract_all(text, F.lit(PART_PATTERN), F.lit(1)),
        lambda part: F.transform(F.split(part, ","), pair),
    )
    parsed = F.struct(kind.alias("type"), parts.alias("parts"))
    open_ring = F.exists(
        parts,
        lambda r: (F.array_size(r) < 4)
        | (F.try_element_at(r, F.lit(1)) != F.try_element_at(r, F.lit(-1))),
    )
    bad = ~text.rlike("(?i)" + WKT_PATTERN) | (kind.isin(POLYGON, MULTIPOLYGON) & open_ring)
    return (
        F.when(text.isNull(), F.lit(None))
        .when(bad, F.raise_error(F.concat(F.lit("not a geometry text: "), text)))
        .otherwise(parsed)
    )


def _number_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _path_text(part: Column) -> Column:
    pairs = F.transform(
        part, lambda p: F.concat_ws(" ", _number_text(p["x"]), _number_text(p["y"]))
    )
    return F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


@named
def st_astext(g: Column | str) -> Column:
    """Well-known text, as ``LINESTRING (0 0, 3 4)``."""
    g = _col(g)
    paths = F.transform(g["parts"], _path_text)
    shells = F.transform(paths, lambda t: F.concat(F.lit("("), t, F.lit(")")))
    body = (
        F.when(F.array_size(g["parts"]) == 0, F.lit("EMPTY"))
        .when(g["type"].isin(POINT, LINESTRING), F.get(paths, F.lit(0)))
        .when(
            g["type"] != MULTIPOLYGON,
            F.concat(F.lit("("), F.array_join(paths, ", "), F.lit(")")),
        )
        .otherwise(F.concat(F.lit("("), F.array_join(shells, ", "), F.lit(")")))
    )
    return F.concat(g["type"], F.lit(" "), body)
