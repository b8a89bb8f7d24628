"""Distance join on a grid: pairs of rows whose geometries are nearer than ``d``.

A partition-based spatial join in DataFrame operations. Each row is placed in the grid cells its
bounding box covers, widened by half of ``d``; what shares a cell is a candidate; a pair is kept
only in its reference cell, so no pair is met twice and nothing has to be made distinct. Long lines
are placed segment by segment, so that a diagonal road does not fill the whole rectangle around it.

Rows travel by tiles of many cells, which a row seldom leaves, and a tile's rows are joined where
they arrive, in numpy; a self join sends them once. A crowded tile is joined cell by cell instead,
by an equi join on the cell, and its crowded cells are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgeo.functions import bbox, distance_once
from roadgeo.operators.tile_join import near_in_tiles
from roadgeo.types import BBOX_COLUMNS, has_bbox

HOT_CELL_ROWS = 20_000  # rows that a split of a cell holds of one side, about
TILE_CELLS = 8  # cells along the side of a tile; a power of two, so that a cell lies in one tile whatever is rounded
KEY_BUCKETS = 1 << 16  # of the hashes of keys that come more than once

BOX = "box"
OWN = "own_"
CELL_RANGE = ("cx0", "cy0", "cx1", "cy1")


def _boxed(df: DataFrame, geom: str) -> DataFrame:
    """Rows with a geometry that is not empty, with their ``box``."""
    stored = F.struct(*[F.col(c) for c in BBOX_COLUMNS])
    box = stored if has_bbox(df) else bbox(geom)
    return df.withColumn(BOX, box).filter(F.col("box.xmin").isNotNull())


# The expressions below are SQL text: as Columns they are thousands of calls, which take longer than planning the join.


def _double(value: float) -> str:
    return f"{value!r}D"


def _is_long(span: float, geom: str) -> Column:
    wide = f"box.xmax - box.xmin > {_double(span)} OR box.ymax - box.ymin > {_double(span)}"
    return F.expr(f"({wide}) AND `{geom}`.type = 'LINESTRING'")


def _segment_boxes(span: float) -> str:
    """Boxes no longer than ``span`` that together cover the segment from p to q."""
    n = f"greatest(ceil(greatest(abs(q.x - p.x), abs(q.y - p.y)) / {_double(span)}), 1L)"
    # more than the rounding of the cut points
    pad = f"({_double(1e-9 * span)} + 1e-14D * (abs(p.x) + abs(p.y) + abs(q.x) + abs(q.y)))"

    def side(choice: str, axis: str) -> str:
        ends = (f"p.{axis} + (q.{axis} - p.{axis}) * ({i} / {n})" for i in ("i", "(i + 1)"))
        return f"{choice}({', '.join(ends)}) {'-' if choice == 'least' else '+'} {pad}"

    sides = zip(BBOX_COLUMNS, (("least", "x"), ("least", "y"), ("greatest", "x"), ("greatest", "y")))
    box = ", ".join(f"'{name}', {side(*how)}" for name, how in sides)
    return f"transform(sequence(0L, {n} - 1), i -> named_struct({box}))"


def _pieces(geom: str, span: float) -> Column:
    """Array of (box, geometry): the whole row, or the segments of a long line."""
    v = f"get(`{geom}`.parts, 0)"
    n = f"greatest(array_size({v}) - 1, 0)"
    line = "named_struct('type', 'LINESTRING', 'parts', array(array(p, q)))"
    piece = f"named_struct('{BOX}', b, 'g', {line})"
    segments = f"zip_with(slice({v}, 1, {n}), slice({v}, 2, {n}), (p, q) -> transform({_segment_boxes(span)}, b -> {piece}))"
    whole = F.expr(f"array(named_struct('{BOX}', {BOX}, 'g', `{geom}`))")
    return F.when(_is_long(span, geom), F.expr(f"flatten({segments})")).otherwise(whole)


def _cell_range(cell: float, margin: float) -> list[Column]:
    """Cells covered by ``box`` after widening it by ``margin``."""

    def edge(name: str, sign: str) -> str:
        side = f"{BOX}.{name}"
        return f"{side} {sign} ({_double(margin)} + abs({side}) * 1e-14D)" if margin else side

    return [
        F.expr(f"cast(floor(({edge(name, sign)}) / {_double(cell)}) AS bigint) AS {out}")
        for name, sign, out in zip(BBOX_COLUMNS, "--++", CELL_RANGE)
    ]


def _in_cells(df: DataFrame) -> DataFrame:
    """One row per covered cell."""
    across = df.withColumn("cx", F.explode(F.sequence("cx0", "cx1")))
    return across.withColumn("cy", F.explode(F.sequence("cy0", "cy1")))


def _kept(df: DataFrame, geom: str) -> list[str]:
    return [c for c in df.columns if c != geom and c not in BBOX_COLUMNS]


def _repeated_keys(df: DataFrame, key: str, geom: str) -> DataFrame:
    """Buckets of the keys that come more than once: at most ``KEY_BUCKETS`` rows."""
    counts = _boxed(df, geom).groupBy(key).count().filter("count > 1")
    return counts.select(_bucket(key)).distinct()


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).alias("_bucket")


def _pieced(df: DataFrame, key: str, geom: str, span: float, repeated: DataFrame | None = None) -> DataFrame:
    """The pieces of all rows: own columns, ``box``, ``g`` and ``several``, whether a pair may be met in more than one of them."""
    boxed = _boxed(df, geom)
    several = F.coalesce(_is_long(span, geom), F.lit(False))
    if repeated is not None:
        boxed = boxed.withColumn("_bucket", _bucket(key)).join(
            F.broadcast(repeated.withColumnRenamed("_bucket", "_again")), F.col("_bucket") == F.col("_again"), "left"
        )
        several |= F.col("_again").isNotNull()
    own = [F.col(c).alias(OWN + c) for c in _kept(df, geom)]
    pieces = boxed.select(*own, several.alias("several"), F.explode(_pieces(geom, span)).alias("piece"))
    return pieces.select("*", F.col("piece.box").alias(BOX), F.col("piece.g").alias("g")).drop("piece")


def _in_tiles(pieces: DataFrame, cell: float, margin: float) -> DataFrame:
    """One row per tile that the box meets after widening it by ``margin``; tx0 and ty0 are the lowest ones."""
    placed = _in_cells(pieces.select("*", *_cell_range(TILE_CELLS * cell, margin)))
    return placed.drop("cx1", "cy1").withColumnsRenamed({"cx": "tx", "cy": "ty", "cx0": "tx0", "cy0": "ty0"})


def _in_tile_cells(tiled: DataFrame, prefix: str, cell: float, margin: float) -> DataFrame:
    """One row per cell of a row's tile that the box meets; own columns get ``prefix``."""
    placed = tiled.select("*", *_cell_range(cell, margin))
    for c in ("x", "y"):
        first = f"greatest(c{c}0, t{c} * {TILE_CELLS})"
        last = f"least(c{c}1, t{c} * {TILE_CELLS} + {TILE_CELLS - 1})"
        placed = placed.withColumn(f"c{c}", F.explode(F.expr(f"if({first} <= {last}, sequence({first}, {last}), array())")))
    own = [F.col(c).alias(prefix + c.removeprefix(OWN)) for c in tiled.columns if c.startswith(OWN)]
    return placed.select(*own, *[F.col(c).alias(prefix + c) for c in (BOX, "g", "cx0", "cy0")], "cx", "cy")


def _crowded(df: DataFrame, geom: str, cell: float, span: float, margin: float, hot_rows: int):
    """Cells holding more than ``hot_rows`` pieces of this side, with the splits they need.

    Only long lines, which are placed by their pieces, have their geometry read for it.
    """
    boxes = _boxed(df, geom)
    long = _is_long(span, geom)
    whole = boxes.filter(~F.coalesce(long, F.lit(False))).select(*_cell_range(cell, margin))
    pieces = boxes.filter(long).select(F.explode(_pieces(geom, span)).alias("piece"))
    pieces = pieces.select(F.col("piece.box").alias(BOX)).select(*_cell_range(cell, margin))
    counts = _in_cells(whole.unionByName(pieces)).groupBy("cx", "cy").count()
    return counts.filter(F.col("count") > hot_rows).select(
        "cx", "cy", F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("splits")
    )


def _split_table(a_hot: DataFrame, b_hot: DataFrame) -> DataFrame:
    """(cx, cy, a_splits, b_splits) of all crowded cells."""
    one = F.lit(1)
    a_part = a_hot.select("cx", "cy", F.col("splits").alias("a_splits"), one.alias("b_splits"))
    b_part = b_hot.select("cx", "cy", one.alias("a_splits"), F.col("splits").alias("b_splits"))
    return (
        a_part.unionByName(b_part)
        .groupBy("cx", "cy")
        .agg(F.max("a_splits").alias("a_splits"), F.max("b_splits").alias("b_splits"))
    )


def _crowded_tiles(a: DataFrame, b: DataFrame, geom: str, cell: float, span: float, margin: float, hot_rows: int) -> DataFrame:
    """(tx, ty) of the tiles in which a side has more than ``hot_rows`` pieces: few, as each holds that many."""
    wide = TILE_CELLS * cell
    hot = _crowded(a, geom, wide, span, margin, hot_rows)
    # of one table, the widened boxes fill each tile at least as much as the boxes themselves
    if a is not b:
        hot = hot.unionByName(_crowded(b, geom, wide, span, 0.0, hot_rows))
    return hot.select(F.col("cx").alias("tx"), F.col("cy").alias("ty")).distinct()


def _hot_cells(side: DataFrame, hot_rows: int) -> DataFrame:
    """The cells with more than ``hot_rows`` rows of a placed side, with the splits they need."""
    counts = side.groupBy("cx", "cy").count().filter(F.col("count") > hot_rows)
    return counts.select("cx", "cy", F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias("splits"))


def _salted(side: DataFrame, prefix: str, key: str, splits: DataFrame) -> DataFrame:
    """Deal the rows of a split cell over its splits, and repeat them for the other side's."""
    own, other = ("a", "b") if prefix == "a_" else ("b", "a")
    # a row for ``hot_rows`` pieces at least, so broadcast: else Spark would shuffle the whole side for it first
    found = side.join(F.broadcast(splits), ["cx", "cy"], "left")
    n_own = F.coalesce(f"{own}_splits", F.lit(1))
    n_other = F.coalesce(f"{other}_splits", F.lit(1))
    dealt = found.withColumn(f"{own}_salt", F.pmod(F.xxhash64(prefix + key), n_own))
    return dealt.withColumn(
        f"{other}_salt",
        F.explode(F.sequence(F.lit(0).cast("bigint"), n_other.cast("bigint") - 1)),
    ).drop("a_splits", "b_splits")


class _Grid:
    """Both sides of a join in pieces, and the ways to pair them."""

    def __init__(self, a, b, d, key, geom, once, cell, hot_rows, find_repeated):
        if not d > 0:
            raise ValueError("the distance must be positive")
        self.d, self.key, self.once, self.hot_rows = d, key, once, hot_rows
        self.cell = cell or 2.0 * d
        self.margin = d * (1 + 1e-9)  # between boxes; each is widened by half of it
        self.half = self.margin / 2
        span = 2.0 * self.cell
        fields = [(p, side.schema[c]) for p, side in (("a_", a), ("b_", b)) for c in _kept(side, geom)]
        self.own = [T.StructField(p + f.name, f.dataType) for p, f in fields]

        def pieced(side):
            return _pieced(side, key, geom, span, _repeated_keys(side, key, geom) if find_repeated else None)

        self.same = a is b
        self.a = pieced(a)
        self.b = self.a if self.same else pieced(b)
        self.tiles = None
        if hot_rows:
            self.tiles = _crowded_tiles(a, b, geom, self.cell, span, self.half, hot_rows)

    def near(self, several: bool | None = None) -> DataFrame:
        """Pairs nearer than the distance in the tiles that are not crowded. ``several`` takes only those with, or only
        those without a side that may be met in several pieces."""

        def named(pieces, prefix, mark):
            own = {c: prefix + c.removeprefix(OWN) for c in pieces.columns if c.startswith(OWN)}
            return pieces.withColumnsRenamed(own).withColumn("from_a", F.lit(mark))

        pieces = self.a if self.same else named(self.a, "a_", True).unionByName(named(self.b, "b_", False), allowMissingColumns=True)
        tiled = _in_tiles(pieces, self.cell, self.half)
        if self.tiles is not None:
            tiled = tiled.join(F.broadcast(self.tiles), ["tx", "ty"], "left_anti")
        dealt = tiled.repartition("tx", "ty").sortWithinPartitions("tx", "ty")
        sizes = (self.d, self.margin, self.cell, TILE_CELLS)
        return near_in_tiles(dealt, *sizes, self.own, self.key, self.once, OWN if self.same else None, several)

    def crowded(self) -> DataFrame | None:
        """Pairs nearer than the distance in crowded tiles: cells are dealt, and crowded ones are split in both directions."""
        if self.tiles is None:
            return None
        left, right = (
            _in_tile_cells(
                _in_tiles(pieces, self.cell, self.half).join(F.broadcast(self.tiles), ["tx", "ty"], "left_semi"),
                prefix, self.cell, self.half,
            )
            for pieces, prefix in ((self.a, "a_"), (self.b, "b_"))
        )
        splits = _split_table(_hot_cells(left, self.hot_rows), _hot_cells(right, self.hot_rows))
        l = _salted(left, "a_", self.key, splits).alias("l")
        r = _salted(right, "b_", self.key, splits).alias("r")
        condition = (
            (F.col("l.cx") == F.greatest("a_cx0", "b_cx0"))
            & (F.col("l.cy") == F.greatest("a_cy0", "b_cy0"))
            & (F.col("a_box.xmin") - self.margin <= F.col("b_box.xmax"))
            & (F.col("b_box.xmin") <= F.col("a_box.xmax") + self.margin)
            & (F.col("a_box.ymin") - self.margin <= F.col("b_box.ymax"))
            & (F.col("b_box.ymin") <= F.col("a_box.ymax") + self.margin)
        )
        for c in ("cx", "cy", "a_salt", "b_salt"):
            condition = (F.col(f"l.{c}") == F.col(f"r.{c}")) & condition
        if self.once:
            condition &= F.col(f"a_{self.key}") < F.col(f"b_{self.key}")
        return _near(l.join(r, condition).select(*[f.name for f in self.own], "a_g", "b_g"), self.d)


def distance_join(
    a: DataFrame,
    b: DataFrame,
    d: float,
    *,
    key: str = "id",
    geom: str = "geometry",
    once: bool = False,
    cell: float | None = None,
    hot_rows: int | None = HOT_CELL_ROWS,
) -> DataFrame:
    """All pairs of a row of ``a`` and a row of ``b`` with distance below ``d``.

    The result holds the columns of ``a`` as ``a_<name>`` and of ``b`` as ``b_<name>`` (without
    geometry and box) and ``distance``. ``key`` is unique on each side. ``once`` keeps pairs with
    ``a.key < b.key`` only, for a self join.

    The grid cell is ``2 d`` wide unless given. A tile in which a side holds more than ``hot_rows``
    rows is joined cell by cell, and a cell with more is split in both directions, so that no task
    gets more than about ``hot_rows`` rows of either side of a cell. A stored bounding box makes
    that count a narrow scan. Polygons are placed by their whole box, so give a larger ``cell`` for
    large ones.

    Only pairs that may be met more than once are shuffled and merged: those with a long line or
    with a key that comes again, and those of crowded tiles.
    """
    grid = _Grid(a, b, d, key, geom, once, cell, hot_rows, find_repeated=True)
    more, crowded = grid.near(several=True), grid.crowded()
    if crowded is not None:
        more = more.unionByName(crowded)
    return grid.near(several=False).unionByName(_merged(more))


def _near(pairs: DataFrame, d: float) -> DataFrame:
    """Pairs of pieces with a distance below ``d``, without their geometry."""
    own = [c for c in pairs.columns if c not in ("a_g", "b_g")]
    return pairs.select(*own, distance_once("a_g", "b_g").alias("distance")).filter(F.col("distance") < d)


def _merged(near: DataFrame) -> DataFrame:
    """Each pair once: the pieces of a long line may meet the same row several times."""
    own = [c for c in near.columns if c != "distance"]
    return near.groupBy(*own).agg(F.min("distance").alias("distance"))


def first_pairs(
    a: DataFrame,
    b: DataFrame,
    d: float,
    n: int,
    *,
    key: str = "id",
    geom: str = "geometry",
    once: bool = False,
    cell: float | None = None,
    hot_rows: int | None = HOT_CELL_ROWS,
) -> DataFrame:
    """The first ``n`` pairs of ``distance_join`` in the order of both keys.

    Every partition keeps the pieces of its first ``n`` distinct pairs, and only these are shuffled and merged.
    """
    grid = _Grid(a, b, d, key, geom, once, cell, hot_rows, find_repeated=False)
    near, crowded = grid.near(), grid.crowded()
    if crowded is not None:
        near = crowded.unionByName(near)
    keys = [f"a_{key}", f"b_{key}"]
    rank = F.dense_rank().over(W.orderBy(*keys))
    first = near.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    return _merged(first).orderBy(*keys).limit(n)
