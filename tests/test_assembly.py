"""Points, ways and relation members from a hand-written element table."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from roadgeo import derived
from roadgeo.functions import st_astext
from roadgeo.operators import assembly
from roadgeo.types import ELEMENTS

NODES = {1: (0.0, 0.0), 2: (3.0, 4.0), 3: (3.0, 5.0), 4: None, 5: (9.0, 9.0)}
WAYS = {
    10: [1, 2, 3],
    11: [1, 2, 3, 1],  # closed
    12: [2, 2, 1],  # a repeated reference stays
    13: [1, 99, 3],  # 99 is absent
    14: [1, 4],  # one located vertex is left
    15: [99, 4],  # none is left
    16: [],
    17: None,
    18: [3, 4, 2],
}
RELATIONS = {
    20: ([10, 3, 11], ["way", "node", "way"]),
    21: ([99], ["way"]),
    22: (None, None),
    10: ([12, 10], ["way", "node"]),  # a node member with the number of a way
    23: ([], []),
}


def element_rows():
    for i, xy in NODES.items():
        place = xy and {"longitude": xy[0], "latitude": xy[1]}
        yield (i, "node", {"n": str(i)}, place, None, None)
    for i, refs in WAYS.items():
        yield (i, "way", {"name": f"w{i}"} if i != 12 else {}, None, refs, None)
    for i, (refs, types) in RELATIONS.items():
        yield (i, "relation", {"type": "route"}, None, refs, types)


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(list(element_rows()), ELEMENTS).repartition(3).cache()


def texts(df):
    return {r["id"]: r["t"] for r in df.select("id", st_astext("geometry").alias("t")).collect()}


def test_points(elements):
    dropped = Observation()
    found = assembly.points(elements, dropped=dropped)
    assert found.columns == ["id", "tags", "geometry"]
    assert texts(found) == {
        i: f"POINT ({p[0]:g} {p[1]:g})" for i, p in NODES.items() if p is not None
    }
    assert dropped.get == {"nodes_without_location": 1}


def test_strict_points(elements):
    with pytest.raises(PySparkException, match="node without location: 4"):
        assembly.points(elements, strict=True).collect()
    assert assembly.points(elements.filter("id <> 4"), strict=True).count() == 4


LINES = {
    10: "LINESTRING (0 0, 3 4, 3 5)",
    11: "LINESTRING (0 0, 3 4, 3 5, 0 0)",
    12: "LINESTRING (3 4, 3 4, 0 0)",
    13: "LINESTRING (0 0, 3 5)",
    18: "LINESTRING (3 5, 3 4)",
}


def test_ways(elements):
    refs, short = Observation(), Observation()
    found = assembly.ways(elements, without_refs=refs, too_short=short)
    assert found.columns == ["id", "tags", "geometry"]
    assert texts(found) == LINES
    assert refs.get == {"ways_without_refs": 2}
    assert short.get == {"ways_with_one_vertex": 1}
    tags = {r["id"]: r["tags"] for r in found.collect()}
    assert tags[10] == {"name": "w10"} and tags[12] == {}


def test_complete_ways(elements):
    found = assembly.ways(elements, require_complete=True)
    assert texts(found) == {k: v for k, v in LINES.items() if k in (10, 11, 12)}


def members(df):
    return [(r["id"], r["ref"], r["ref_type"]) for r in df.collect()]


def test_relation_members(elements):
    typed = assembly.relation_members(elements)
    assert typed.columns == ["id", "ref", "ref_type", "tags", "geometry"]
    assert members(typed) == [(10, 12, "way"), (20, 10, "way"), (20, 11, "way")]
    assert members(assembly.relation_members(elements, "any")) == [
        (10, 10, "node"), (10, 12, "way"), (20, 10, "way"), (20, 11, "way"),
    ]
    stored = assembly.relation_members(elements, ways_table=assembly.ways(elements))
    assert members(stored) == members(typed)
    with pytest.raises(ValueError):
        assembly.relation_members(elements, "nodes")


def test_relations_without_refs_are_counted(elements):
    seen = Observation()
    assembly.relation_members(elements, without_refs=seen).collect()
    assert seen.get == {"relations_without_refs": 2}


def test_export_form(elements):
    export = assembly.as_export(assembly.ways(elements))
    assert export.columns == ["osm_id", "tags", "geometry"] and export.count() == len(LINES)


def test_a_node_shared_by_very_many_ways_is_split(spark):
    """A hot node id does not end up in one task."""
    n = 30_000
    nodes = spark.range(2 * n).select(
        "id", F.lit("node").alias("kind"),
        F.struct(F.col("id").cast("double").alias("longitude"), F.lit(0.0).alias("latitude")).alias("location"),
        F.lit(None).cast("array<bigint>").alias("refs"),
    )
    ways = spark.range(n).select(
        "id", F.lit("way").alias("kind"),
        F.lit(None).cast("struct<longitude:double,latitude:double>").alias("location"),
        F.array(F.lit(0).cast("bigint"), F.col("id") + 1).alias("refs"),
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        vertices = assembly.way_vertices(nodes.unionByName(ways))
        assert vertices.count() == 2 * n
        vertices.collect()
        plan = vertices._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stored_vertices_give_the_same_ways(spark, sf_dir, tmp_path):
    elements = derived.elements(spark, sf_dir)
    path = str(tmp_path / "vertices")
    assembly.way_vertices(elements).write.parquet(path)
    again = assembly.ways(elements, vertices=spark.read.parquet(path)).select("id", "geometry")
    whole = assembly.ways(elements).select("id", "geometry")
    assert again.count() == whole.count() and again.exceptAll(whole).count() == 0
