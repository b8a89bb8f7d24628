"""Window filter: rows whose geometry meets a fixed region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgeo.functions import bbox, parse_wkt, st_intersects
from roadgeo.types import BBOX_COLUMNS, has_bbox


def _box_of(parts) -> tuple[float, float, float, float]:
    xs = [x for part in parts for x, _ in part]
    ys = [y for part in parts for _, y in part]
    return min(xs), min(ys), max(xs), max(ys)


def _is_box(kind: str, parts) -> bool:
    """Is the region exactly its bounding box?"""
    if kind != "POLYGON" or len(parts) != 1 or len(parts[0]) != 5:
        return False
    ring = parts[0]
    xmin, ymin, xmax, ymax = _box_of(parts)
    corners = {(xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax)}
    upright = all(a[0] == b[0] or a[1] == b[1] for a, b in zip(ring, ring[1:]))
    return set(ring) == corners and len(corners) == 4 and upright


def range_filter(df: DataFrame, window: str, geom: str = "geometry") -> DataFrame:
    """Rows of ``df`` whose geometry shares a point with the region ``window`` (geometry text).

    Stored bounding box columns are compared first, as plain predicates that reach the Parquet
    scan. Only rows the boxes leave open go to the exact test: for a rectangular window a row
    whose own box lies inside it needs none.
    """
    kind, parts = parse_wkt(window)
    if not parts:
        return df.filter(F.lit(False))
    wx0, wy0, wx1, wy1 = _box_of(parts)
    names = list(df.columns)
    if has_bbox(df):
        boxed, box = df, {c: F.col(c) for c in BBOX_COLUMNS}
    else:
        boxed = df.withColumn("_box", bbox(geom))
        box = {c: F.col("_box")[c] for c in BBOX_COLUMNS}

    near: Column = (
        (box["xmin"] <= wx1) & (box["xmax"] >= wx0) & (box["ymin"] <= wy1) & (box["ymax"] >= wy0)
    )
    inside = F.lit(False)
    if _is_box(kind, parts):
        inside = (
            (box["xmin"] >= wx0)
            & (box["xmax"] <= wx1)
            & (box["ymin"] >= wy0)
            & (box["ymax"] <= wy1)
        )
    open_geometry = F.when(~inside, F.col(geom))
    return (
        boxed.filter(near)
        .withColumn("_meets", st_intersects(open_geometry, wkt=window))
        .filter(inside | F.col("_meets"))
        .select(*names)
    )
