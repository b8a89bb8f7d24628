"""The geometry type and the schemas of the tables built around it.

Coordinates are planar degrees, x = longitude and y = latitude.

===============  =============================================================
type             parts
===============  =============================================================
POINT            one part with one vertex
LINESTRING       one part with two or more vertices
POLYGON          shell first, then the holes; every ring is closed
MULTIPOLYGON     each part is one closed, hole-free shell; interiors disjoint
MULTIPOINT       each part has one vertex
MULTILINESTRING  each part has two or more vertices
===============  =============================================================

An empty geometry has no parts.
"""

from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(VERTEX))),
    ]
)

TAGS = T.MapType(T.StringType(), T.StringType())

ELEMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField(
            "location",
            T.StructType(
                [
                    T.StructField("longitude", T.DoubleType()),
                    T.StructField("latitude", T.DoubleType()),
                ]
            ),
        ),
        T.StructField("refs", T.ArrayType(T.LongType())),
        T.StructField("ref_types", T.ArrayType(T.StringType())),
    ]
)

# Bounding box columns kept next to a stored geometry; Parquet row groups are pruned on them.
BBOX_COLUMNS = ("xmin", "ymin", "xmax", "ymax")


def is_geometry(data_type: T.DataType) -> bool:
    """Is this the geometry type? Nullability of the nested fields does not matter."""
    return data_type.simpleString() == GEOMETRY.simpleString()


def geometry_columns(df) -> list[str]:
    """Names of the geometry columns of ``df``, in order."""
    return [f.name for f in df.schema.fields if is_geometry(f.dataType)]


def has_bbox(df) -> bool:
    """Does ``df`` carry the stored bounding box columns?"""
    return set(BBOX_COLUMNS) <= set(df.columns)
