"""The geometry functions as functions of SQL text.

``register_functions(spark)`` makes ``st_length``, ``st_area`` and the rest known to ``spark.sql``. Those that Catalyst can
express are temporary SQL functions: the analyzer puts their bodies in place of the calls, so they are optimised and
compiled as if they had been written out. The others are the Arrow functions of `arrow`.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgeo.functions import kernels
from roadgeo.functions.geometry import PART_PATTERN, WKT_PATTERN
from roadgeo.types import GEOMETRY

_G = GEOMETRY.simpleString()
_SUMS = ("w", "wx", "wy")


def _segments(v: str, body: str) -> str:
    """Array of body(p, q) over the consecutive vertices of v."""
    n = f"greatest(array_size({v}) - 1, 0)"
    return f"zip_with(slice({v}, 1, {n}), slice({v}, 2, {n}), (p, q) -> {body})"


def _total(values: str) -> str:
    return f"aggregate({values}, 0D, (acc, d) -> acc + d)"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _sum_of(items: str) -> str:
    """Sum of (w, wx, wy) structs."""
    zero, more = _struct(**dict.fromkeys(_SUMS, "0D")), _struct(**{f: f"acc.{f} + i.{f}" for f in _SUMS})
    return f"aggregate({items}, {zero}, (acc, i) -> {more})"


def _weighted(w: str, x: str, y: str) -> str:
    return _struct(w=w, wx=f"({w}) * ({x})", wy=f"({w}) * ({y})")


def _shape(kind: str, parts: str) -> str:
    return _struct(type=f"'{kind}'", parts=parts)


def _point(x: str, y: str) -> str:
    return _shape("POINT", f"array(array({_struct(x=x, y=y)}))")


_CROSS = "((p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y))"
_STEP = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))"
_AREAS = f"transform(g.parts, ring -> abs({_let('o', 'get(ring, 0)', _total(_segments('ring', _CROSS)))}) / 2D)"
_FILLED = "g IS NOT NULL AND array_size(flatten(g.parts)) > 0"


def _area() -> str:
    total = _total("a")
    return f"""CASE WHEN g IS NULL THEN NULL
      WHEN g.type = 'POLYGON' THEN {_let('a', _AREAS, f"2D * coalesce(get(a, 0), 0D) - {total}")}
      WHEN g.type = 'MULTIPOLYGON' THEN {_let('a', _AREAS, total)} ELSE 0D END"""


def _envelope() -> str:
    ends = _struct(**{f"{m}_{c}": f"array_{m}(transform(flatten(g.parts), v -> v.{c}))" for m in ("min", "max") for c in "xy"})
    corner = lambda a, b: _struct(x=f"b.{a}_x", y=f"b.{b}_y")
    low, high = corner("min", "min"), corner("max", "max")
    ring = f"array({low}, {corner('min', 'max')}, {high}, {corner('max', 'min')}, {low})"
    return _let("b", ends, f"""CASE WHEN b.min_x IS NULL THEN NULL
      WHEN b.min_x = b.max_x AND b.min_y = b.max_y THEN {_shape('POINT', f'array(array({low}))')}
      WHEN b.min_x = b.max_x OR b.min_y = b.max_y THEN {_shape('LINESTRING', f'array(array({low}, {high}))')}
      ELSE {_shape('POLYGON', f'array({ring})')} END""")


def _centroid() -> str:
    """By area, else by length, else the mean vertex."""
    ring = _sum_of(_segments("ring", _weighted(_CROSS, "(p.x + q.x + o.x) / 3D", "(p.y + q.y + o.y) / 3D")))
    sign = "(CASE WHEN g.type = 'POLYGON' AND nth > 0 THEN -1D ELSE 1D END * CASE WHEN s.w < 0 THEN -1D ELSE 1D END)"
    signed = _let("s", _let("o", "get(ring, 0)", ring), _struct(**{f: f"{sign} * s.{f}" for f in _SUMS}))
    nothing = _struct(**dict.fromkeys(_SUMS, "0D"))
    by_area = f"CASE WHEN g.type IN ('POLYGON', 'MULTIPOLYGON') THEN {_sum_of(f'transform(g.parts, (ring, nth) -> {signed})')} ELSE {nothing} END"
    by_length = _sum_of(f"flatten(transform(g.parts, part -> {_segments('part', _weighted(_STEP, '(p.x + q.x) / 2D', '(p.y + q.y) / 2D'))}))")
    by_vertex = _sum_of(f"transform(flatten(g.parts), v -> {_weighted('1D', 'v.x', 'v.y')})")
    first = _let("m", f"array({by_area}, {by_length}, {by_vertex})", "get(filter(m, c -> c.w <> 0), 0)")
    return f"CASE WHEN {_FILLED} THEN {_let('m', first, _point('m.wx / m.w', 'm.wy / m.w'))} END"


def _end(index: int) -> str:
    return f"CASE WHEN g.type = 'LINESTRING' AND array_size(get(g.parts, 0)) > 0 THEN {_shape('POINT', f'array(array(element_at(get(g.parts, 0), {index})))')} END"


def _make_line() -> str:
    vertices = "flatten(flatten(transform(filter(points, e -> e IS NOT NULL), e -> e.parts)))"
    empty = "CASE WHEN array_size(v) = 0 THEN slice(array(v), 1, 0) ELSE array(v) END"
    checked = f"CASE WHEN array_size(v) = 1 THEN raise_error('a line needs no vertex or at least two') ELSE {_shape('LINESTRING', empty)} END"
    return f"CASE WHEN points IS NOT NULL THEN {_let('v', vertices, checked)} END"


def _text() -> str:
    number = lambda c: f"regexp_replace(cast(v.{c} AS STRING), '[.]0$', '')"
    paths = f"transform(g.parts, part -> concat('(', array_join(transform(part, v -> concat_ws(' ', {number('x')}, {number('y')})), ', '), ')'))"
    body = """CASE WHEN array_size(t) = 0 THEN 'EMPTY' WHEN g.type IN ('POINT', 'LINESTRING') THEN get(t, 0)
      WHEN g.type <> 'MULTIPOLYGON' THEN concat('(', array_join(t, ', '), ')')
      ELSE concat('(', array_join(transform(t, s -> concat('(', s, ')')), ', '), ')') END"""
    return f"concat(g.type, ' ', {_let('t', paths, body)})"


def _from_text() -> str:
    """As the column function: a text that is no geometry is an error."""
    pair = "split(trim(regexp_replace(v, r'\\s+', ' ')), ' ')"
    vertex = _let("n", pair, _struct(x="cast(get(n, 0) AS DOUBLE)", y="cast(get(n, 1) AS DOUBLE)"))
    parts = f"transform(regexp_extract_all(text, r'{PART_PATTERN}', 1), part -> transform(split(part, ','), v -> {vertex}))"
    open_ring = "exists(g.parts, r -> array_size(r) < 4 OR try_element_at(r, 1) <> try_element_at(r, -1))"
    checked = f"""CASE WHEN g.type IN ('POLYGON', 'MULTIPOLYGON') AND {open_ring}
      THEN raise_error(concat('not a geometry text: ', text)) ELSE g END"""
    parsed = _struct(type="upper(regexp_extract(text, r'^\\s*(\\w+)', 1))", parts=parts)
    return f"""CASE WHEN text IS NULL THEN NULL
      WHEN NOT text RLIKE r'(?i){WKT_PATTERN}' THEN raise_error(concat('not a geometry text: ', text)) ELSE {_let('g', parsed, checked)} END"""


def sql_functions() -> dict[str, tuple[str, str, str]]:
    """Parameters, result type and body of each function that Catalyst expresses."""
    line = "g.type = 'LINESTRING' AND get(g.parts, 0) IS NOT NULL"
    first = "get(get(g.parts, 0), 0)"
    return {
        "st_point": ("x DOUBLE, y DOUBLE", _G, f"CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {_point('x', 'y')} END"),
        "st_makeline": (f"points ARRAY<{_G}>", _G, _make_line()),
        "st_length": (f"g {_G}", "DOUBLE", f"CASE WHEN g IS NULL THEN NULL WHEN {line} THEN {_total(_segments('get(g.parts, 0)', _STEP))} WHEN g.type = 'MULTILINESTRING' THEN {_total(f"transform(g.parts, part -> {_total(_segments('part', _STEP))})")} ELSE 0D END"),
        "st_numpoints": (f"g {_G}", "INT", "CASE WHEN g.type = 'LINESTRING' THEN coalesce(array_size(get(g.parts, 0)), 0) END"),
        "st_area": (f"g {_G}", "DOUBLE", _area()),
        "st_envelope": (f"g {_G}", _G, _envelope()),
        "st_centroid": (f"g {_G}", _G, _centroid()),
        "st_startpoint": (f"g {_G}", _G, _end(1)),
        "st_endpoint": (f"g {_G}", _G, _end(-1)),
        "st_x": (f"g {_G}", "DOUBLE", f"CASE WHEN g.type = 'POINT' THEN {first}.x END"),
        "st_y": (f"g {_G}", "DOUBLE", f"CASE WHEN g.type = 'POINT' THEN {first}.y END"),
        "st_geomfromwkt": ("text STRING", _G, _from_text()),
        "st_astext": (f"g {_G}", "STRING", _text()),
    }


@F.arrow_udf(T.BooleanType())
def _intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = kernels.Batch.of(a), kernels.Batch.of(b)
    return pa.array(kernels.intersects(kernels.Outline.of(left), kernels.Outline.of(right)), pa.bool_(), mask=~(left.valid & right.valid))


@F.arrow_udf(T.DoubleType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = kernels.Batch.of(a), kernels.Batch.of(b)
    values = kernels.distance(kernels.Outline.of(left), kernels.Outline.of(right))
    return pa.array(values, pa.float64(), mask=~(left.valid & right.valid) | (values != values))


@F.arrow_udf(GEOMETRY)
def _buffer(g: pa.Array, d: pa.Array) -> pa.Array:
    """One pass for each distance of the batch; a constant distance has one."""
    if not len(g):
        return kernels.buffer(kernels.Batch.of(g), 0.0)
    distances = d.dictionary_encode()
    picked, order = [], []
    for code, value in enumerate(distances.dictionary.to_pylist()):
        rows = pc.indices_nonzero(pc.equal(distances.indices, code))
        picked.append(kernels.buffer(kernels.Batch.of(g.take(rows)), float(value)))
        order.extend(rows.to_pylist())
    if d.null_count:
        rows = pc.indices_nonzero(d.is_null())
        picked.append(pa.nulls(len(rows), g.type if not picked else picked[0].type))
        order.extend(rows.to_pylist())
    place = pc.sort_indices(pa.array(order, pa.int64()))
    return pa.concat_arrays(picked).take(place)


@F.arrow_udf(T.BinaryType())
def _as_wkb(g: pa.Array) -> pa.Array:
    return kernels.to_wkb(kernels.Batch.of(g))


@F.arrow_udf(GEOMETRY)
def _from_wkb(data: pa.Array) -> pa.Array:
    return kernels.from_wkb(data)


def register_functions(spark: SparkSession) -> None:
    """Makes the geometry functions known to SQL text of this session."""
    for name, (parameters, result, body) in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, function in {"st_intersects": _intersects, "st_distance": _distance, "st_buffer": _buffer, "st_aswkb": _as_wkb, "st_geomfromwkb": _from_wkb}.items():
        spark.udf.register(name, function)
