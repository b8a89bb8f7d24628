"""What the plans must and must not contain."""

import pathlib
import re

import pytest

from roadgeo import derived
from roadgeo.operators import assembly, runs
from roadgeo.plans import road_queries as Q
from roadgeo.sources import tables

LIBRARY = pathlib.Path(__file__).parent.parent / "roadgeo"


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "ways")
    ways = assembly.ways(derived.elements(spark, sf_dir))
    tables.write_geometry_parquet(ways, path, keep_tags=["highway", "name"], cluster_cell=0.05)
    return tables.read_geometry_parquet(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_count_reads_no_columns(stored):
    assert "ReadSchema: struct<>" in plan(Q.count_roads(stored))


def test_statistics_read_no_other_columns(stored):
    text = plan(Q.roads_by_highway_type(stored))
    assert "tags" not in re.search(r"FileScan parquet \[(.*?)\]", text).group(1)
    assert "PushedFilters: [IsNotNull(tag_highway)]" in text


def test_window_reaches_the_scan(stored, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    try:
        text = plan(Q.spatial_filter(stored))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("LessThanOrEqual(xmin,15.95)", "GreaterThanOrEqual(xmax,15.94)"):
        assert part in pushed
    assert text.count("ArrowEvalPython") == 1


def test_joins_are_equi_joins(stored):
    text = plan(Q.nearby_roads(stored))
    assert "NestedLoop" not in text and "Cartesian" not in text
    # the filter on the distance does not compute it a second time
    assert text.count("ArrowEvalPython") == 1


def test_assembly_does_not_shuffle_tags_with_vertices(spark, sf_dir):
    elements = derived.elements(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(assembly.way_vertices(elements))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in text and "tags" not in text


@pytest.mark.parametrize(
    "query", [Q.buffer_analysis, Q.envelope_bbox, Q.road_centroids, Q.start_end_points, Q.road_complexity]
)
def test_limited_queries_take_the_top_first(stored, query):
    df = query(stored)
    text = plan(df)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    if "ArrowEvalPython" in text:
        assert text.index("ArrowEvalPython") < text.index("TakeOrderedAndProject")


def test_nearby_pairs_are_cut_before_they_are_shuffled(stored):
    """No exchange lies between the distances and the limit on ranks: only the first pairs travel."""
    text = plan(Q.self_join_nearby(stored))
    above = text[: text.index("ArrowEvalPython")].splitlines()
    kept = [line.split("(")[0].split("[")[0].strip("*+-: 0123456789)") for line in above]
    limits = [i for i, line in enumerate(above) if "WindowGroupLimit" in line]
    exchanges = [i for i, line in enumerate(above) if "Exchange" in line]
    assert len(limits) == 2 and exchanges and max(exchanges) < max(limits), kept


def test_grouped_statistics_combine_before_the_shuffle(stored, spark, sf_dir):
    for df in (Q.road_statistics(stored), runs.run_summary(derived.runs(spark, sf_dir))):
        text = plan(df)
        assert text.index("partial_") > text.index("Exchange hashpartitioning")


def test_library_keeps_data_off_the_driver():
    for path in LIBRARY.rglob("*.py"):
        if "llm" in path.relative_to(LIBRARY).parts:
            continue  # its operators collect models of stated size, which their own tests cover
        text = path.read_text()
        for call in (".collect(", ".toPandas(", ".toLocalIterator(", "localCheckpoint", ".rdd", "crossJoin"):
            assert call not in text, f"{call} in {path.name}"


def test_pairs_met_once_are_not_shuffled(stored):
    """Rows travel by tile; the pairs of short roads with keys of their own are the result as they are found."""
    text = plan(Q.nearby_roads(stored))
    first = text[text.index("Union") : text.index("MapInArrow")]
    assert "Exchange" not in first and "Aggregate" not in first
    assert text.index("Exchange hashpartitioning(tx") > text.index("MapInArrow")


def test_first_pairs_read_each_road_from_one_exchange(stored):
    """A self join sends its rows once, not once for each side and again for the table of crowded cells."""
    text = plan(Q.self_join_nearby(stored))
    assert text.count("Exchange hashpartitioning(tx") == 1 and text.count("MapInArrow") == 1
    assert "splits" not in text[text.rindex("MapInArrow") :]
