"""The pairs of near rows within the tiles of a grid, in numpy.

A task gets the rows of its tiles one tile after the other and joins whole tiles, many small ones at a time. What it
holds at once is a few Arrow batches, or a tile: the caller keeps crowded tiles away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from roadgeo.functions import kernels

CHUNK_ROWS = 1 << 15  # rows joined at a time, if tiles are small
ROW_BYTES = 1 << 11  # of a row that counts as one: larger ones count as several
PAIR_BLOCK = 1 << 18  # candidates looked at a time


def _weight(rows: pa.RecordBatch | pa.Table) -> int:
    return max(rows.num_rows, rows.nbytes // ROW_BYTES)


def whole_tiles(batches: Iterator[pa.RecordBatch], at_least: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Rows that are sorted by tile, in tables of whole tiles with about as many rows."""
    held: list[pa.RecordBatch] = []
    weight, enough = 0, at_least
    for batch in batches:
        held.append(batch)
        weight += _weight(batch)
        if weight < enough:
            continue
        table = pa.Table.from_batches(held)
        cut = _starts(table)[-1]
        if not cut:  # one tile so far
            enough = 2 * weight
            continue
        yield table.slice(0, cut)
        rest = table.slice(cut)
        held, weight = rest.to_batches(), _weight(rest)
        enough = max(at_least, 2 * weight)
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _starts(table: pa.Table) -> np.ndarray:
    """Where each tile starts."""
    tx, ty = _numbers(table, "tx"), _numbers(table, "ty")
    return np.flatnonzero(np.concatenate([[True], (np.diff(tx) != 0) | (np.diff(ty) != 0)]))


@dataclass
class _Tiles:
    """Rows of whole tiles."""

    tile: np.ndarray  # running number of the row's tile
    low: np.ndarray  # (2, n) boxes
    high: np.ndarray
    first: np.ndarray  # (2, n) cells that the widened box meets, counted within the tile
    last: np.ndarray
    lowest: np.ndarray  # (2, n) the lowest tiles that the widened box meets
    place: np.ndarray  # (2, n) the row's tile

    @classmethod
    def of(cls, table: pa.Table, margin: float, cell: float, tile_cells: int) -> "_Tiles":
        starts = _starts(table)
        box = table.column("box").combine_chunks().flatten()
        xmin, ymin, xmax, ymax = (v.to_numpy(zero_copy_only=False) for v in box)
        low, high = np.stack([xmin, ymin]), np.stack([xmax, ymax])
        place = np.stack([_numbers(table, "tx"), _numbers(table, "ty")])
        corner = place * float(tile_cells)

        def cells(edge: np.ndarray, way: int) -> np.ndarray:
            wide = edge + way * (margin / 2 + np.abs(edge) * 1e-14)
            return np.clip(np.floor(wide / cell) - corner, 0, tile_cells - 1).astype(np.int64)

        return cls(
            np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows))),
            low,
            high,
            cells(low, -1),
            cells(high, 1),
            np.stack([_numbers(table, "tx0"), _numbers(table, "ty0")]),
            place,
        )

    def in_cells(self, rows: np.ndarray, tile_cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows, once for each of their cells, and the cells."""
        wide, tall = (self.last - self.first + 1)[:, rows]
        count = wide * tall
        again = np.repeat(rows, count)
        nth = kernels.runs(np.zeros(len(rows), np.int64), count)
        tall = np.repeat(tall, count)
        cx, cy = self.first[0, again] + nth // tall, self.first[1, again] + nth % tall
        return again, (self.tile[again] * tile_cells + cx) * tile_cells + cy

    def near(self, i: np.ndarray, j: np.ndarray, code: np.ndarray, margin: float, tile_cells: int) -> np.ndarray:
        """Which candidates of a cell are in their reference cell and tile and have boxes within ``margin``."""
        cell = np.maximum(self.first[:, i], self.first[:, j])
        good = (self.tile[i] * tile_cells + cell[0]) * tile_cells + cell[1] == code
        for axis in (0, 1):
            good &= np.maximum(self.lowest[axis, i], self.lowest[axis, j]) == self.place[axis, i]
            good &= self.low[axis, i] - margin <= self.high[axis, j]
            good &= self.low[axis, j] <= self.high[axis, i] + margin
        return good


def _candidates(tiles: _Tiles, a_rows: np.ndarray, b_rows: np.ndarray, rank: np.ndarray | None, itself: bool, tile_cells: int):
    """Blocks of (a row, b row, cell) that share a cell, where ``rank`` is given only those with the lower one first."""
    b, b_code = tiles.in_cells(b_rows, tile_cells)
    order = np.argsort(b_code, kind="stable") if rank is None else np.lexsort((rank[b], b_code))
    b, b_code = b[order], b_code[order]
    if itself and rank is not None:  # each entry with those behind it in its cell
        a, a_code, start = b, b_code, np.arange(1, len(b) + 1)
    else:
        a, a_code = (b, b_code) if itself else tiles.in_cells(a_rows, tile_cells)
        start = np.searchsorted(b_code, a_code, "left")
    count = np.searchsorted(b_code, a_code, "right") - start
    ends = np.cumsum(count)
    at = 0
    while at < len(a):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIR_BLOCK, "right")))
        part = slice(at, stop)
        i = np.repeat(a[part], count[part])
        j = b[kernels.runs(start[part], count[part])]
        code = np.repeat(a_code[part], count[part])
        if rank is not None:
            ordered = rank[i] < rank[j]
            i, j, code = i[ordered], j[ordered], code[ordered]
        yield i, j, code
        at = stop


def _ranks(keys: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the keys, equal for equal ones."""
    if pa.types.is_integer(keys.type):
        return pc.fill_null(keys, 0).to_numpy()
    return pc.rank(keys.combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)


def near_in_tiles(
    df: DataFrame,
    d: float,
    margin: float,
    cell: float,
    tile_cells: int,
    own: list[T.StructField],
    key: str,
    once: bool,
    itself: str | None,
    several: bool | None,
) -> DataFrame:
    """Pairs of a row of side a and one of side b with a distance below ``d``: the columns ``own`` and ``distance``.

    ``df`` holds rows sorted by tile (tx, ty), with ``box``, the geometry ``g``, ``several`` and the lowest tile that the
    row is in (tx0, ty0); ``from_a`` tells the sides apart. If ``itself`` is given all rows are of both sides, and their own
    columns begin with it instead of with the side. ``once`` keeps pairs with ``a.key < b.key`` only, and ``several``
    those where a row of the pair, or no row, is marked so.
    """
    schema = T.StructType([*own, T.StructField("distance", T.DoubleType())])
    sources = [f.name if itself is None else itself + f.name[2:] for f in own]
    keys = [f"{itself or p}{key}" for p in ("a_", "b_")]

    def joined(table: pa.Table) -> Iterator[pa.RecordBatch]:
        marked = _numbers(table, "several")
        if several and not marked.any():
            return
        tiles = _Tiles.of(table, margin, cell, tile_cells)
        rows = np.arange(table.num_rows)
        sides = [rows, rows]
        if itself is None:
            from_a = _numbers(table, "from_a")
            sides = [rows[from_a], rows[~from_a]]
        rank = None
        if once:
            keyed = [table.column(k) for k in keys]
            sides = [side[column.is_valid().to_numpy()[side]] for side, column in zip(sides, keyed)]
            rank = _ranks(keyed[0] if itself else pc.coalesce(*keyed))
        shapes = kernels.Outline.of(kernels.Batch.of(table.column("g").combine_chunks()))
        columns = [table.column(name).combine_chunks() for name in sources]
        for i, j, code in _candidates(tiles, *sides, rank, itself is not None, tile_cells):
            good = tiles.near(i, j, code, margin, tile_cells)
            if several is not None:
                good &= (marked[i] | marked[j]) == several
            i, j = i[good], j[good]
            values = kernels.distance(shapes.take(i), shapes.take(j))
            near = values < d
            picks = {"a_": pa.array(i[near]), "b_": pa.array(j[near])}
            found = [c.take(picks[f.name[:2]]) for f, c in zip(own, columns)]
            yield pa.RecordBatch.from_arrays([*found, pa.array(values[near])], names=schema.names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tiles(batch for batch in batches if batch.num_rows):
            yield from joined(table)

    return df.mapInArrow(near, schema)
