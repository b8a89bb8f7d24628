"""OSM elements to geometry tables: points, road lines and relation members.

Element ids are unique within a kind, as they are in an OSM extract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roadgeo.functions import line_from_vertices, st_point


def of_kind(elements: DataFrame, kind: str) -> DataFrame:
    """Elements of one kind: ``node``, ``way`` or ``relation``."""
    return elements.filter(F.col("kind") == kind)


def _located() -> Column:
    return F.col("location.longitude").isNotNull() & F.col("location.latitude").isNotNull()


def _has_refs() -> Column:
    return F.coalesce(F.array_size("refs"), F.lit(0)) > 0


def _count_if(df: DataFrame, observation: Observation | None, condition: Column, name: str):
    """Count rows while they pass by; the number is ready after the first action."""
    if observation is None:
        return df
    return df.observe(observation, F.count_if(condition).alias(name))


def points(
    elements: DataFrame, strict: bool = False, dropped: Observation | None = None
) -> DataFrame:
    """Node points ``(id, tags, geometry)``.

    A node without location is dropped, and counted in ``dropped`` as ``nodes_without_location``;
    with ``strict`` it is an error.
    """
    nodes = of_kind(elements, "node")
    point = st_point("location.longitude", "location.latitude")
    if strict:
        message = F.concat(F.lit("node without location: "), F.col("id").cast("string"))
        point = F.when(_located(), point).otherwise(F.raise_error(message))
    else:
        nodes = _count_if(nodes, dropped, ~_located(), "nodes_without_location")
        nodes = nodes.filter(_located())
    return nodes.select("id", "tags", point.alias("geometry"))


def way_vertices(elements: DataFrame, without_refs: Observation | None = None) -> DataFrame:
    """Located vertices of all ways: ``(way_id, pos, x, y)``.

    ``pos`` is the position in ``refs``. References to absent or unlocated nodes vanish.
    Only ids and coordinates are shuffled. The join is an inner equi join on the node id, so a
    node that very many ways share is split by the adaptive skew join.
    """
    ways_ = _count_if(
        of_kind(elements, "way"), without_refs, ~_has_refs(), "ways_without_refs"
    )
    refs = ways_.filter(_has_refs()).select(
        F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node_id")
    )
    nodes = (
        of_kind(elements, "node")
        .filter(_located())
        .select(
            F.col("id").alias("node_id"),
            F.col("location.longitude").alias("x"),
            F.col("location.latitude").alias("y"),
        )
    )
    return refs.join(nodes, "node_id").select("way_id", "pos", "x", "y")


def ways(
    elements: DataFrame,
    require_complete: bool = False,
    without_refs: Observation | None = None,
    too_short: Observation | None = None,
    vertices: DataFrame | None = None,
) -> DataFrame:
    """Road lines ``(id, tags, geometry)``, vertices in reference order.

    Repeated references stay, so a closed way gives a closed line. A way with fewer than two
    located vertices is dropped; those with one are counted in ``too_short`` as
    ``ways_with_one_vertex``, those without references in ``without_refs`` as
    ``ways_without_refs``. With ``require_complete`` a way also needs every reference resolved.

    Stored ``vertices`` of ``way_vertices`` save finding them again, and ``without_refs`` is theirs then.

    A line is one row, so a group is one way. Tags do not travel with the vertices; they join the
    finished lines, which are already placed by id.
    """
    found = way_vertices(elements, without_refs) if vertices is None else vertices
    gathered = (
        found.repartition("way_id")  # as they are: gathered in part by node they are larger, and are sorted once more
        .groupBy("way_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("v"))
    )
    gathered = _count_if(gathered, too_short, F.array_size("v") < 2, "ways_with_one_vertex")
    lines = gathered.filter(F.array_size("v") >= 2).select(
        F.col("way_id").alias("id"),
        F.array_size("v").alias("n_vertices"),
        line_from_vertices(
            F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        ).alias("geometry"),
    )
    described = of_kind(elements, "way")  # its refs are read again only where they are compared
    joined = described.select("id", "tags", F.array_size("refs").alias("n_refs")).join(lines, "id")
    if require_complete:
        joined = joined.filter(F.col("n_refs") == F.col("n_vertices"))
    return joined.select("id", "tags", "geometry")


def relation_refs(elements: DataFrame, without_refs: Observation | None = None) -> DataFrame:
    """One row per member: ``(id, ref, ref_type, tags)``."""
    relations = _count_if(
        of_kind(elements, "relation"), without_refs, ~_has_refs(), "relations_without_refs"
    )
    return (
        relations.filter(_has_refs())
        .select("id", "tags", F.explode(F.arrays_zip("refs", "ref_types")).alias("m"))
        .select(
            "id",
            F.col("m.refs").alias("ref"),
            F.col("m.ref_types").alias("ref_type"),
            "tags",
        )
    )


def relation_members(
    elements: DataFrame,
    members: str = "way",
    ways_table: DataFrame | None = None,
    without_refs: Observation | None = None,
) -> DataFrame:
    """Member ways of relations ``(id, ref, ref_type, tags, geometry)``, sorted by id and ref.

    ``members="way"`` takes members typed as ways; ``"any"`` matches on the number alone, so a
    node member whose number is also that of a way counts too. A stored ``ways_table`` saves
    assembling the lines again.
    """
    if members not in ("way", "any"):
        raise ValueError(f"members must be 'way' or 'any', not {members!r}")
    refs = relation_refs(elements, without_refs)
    if members == "way":
        refs = refs.filter(F.col("ref_type") == "way")
    lines = ways(elements) if ways_table is None else ways_table
    lines = lines.select(F.col("id").alias("ref"), "geometry")
    return (
        refs.join(lines, "ref")
        .select("id", "ref", "ref_type", "tags", "geometry")
        .orderBy("id", "ref")
    )


def as_export(table: DataFrame) -> DataFrame:
    """The export form of a geometry table: ``(osm_id, tags, geometry)``."""
    return table.select(F.col("id").alias("osm_id"), "tags", "geometry")
