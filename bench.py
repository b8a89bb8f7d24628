"""Time the road queries on stored tables: one JSON line.

The road tables are built once from the element table and written as Parquet; every query then
runs over the stored ways. Each figure is the mean of the measured runs after warm-up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from roadgeo import derived  # noqa: E402
from roadgeo.functions import st_distance  # noqa: E402
from roadgeo.operators import runs  # noqa: E402
from roadgeo.plans import road_queries as roads  # noqa: E402
from roadgeo.sources import tables  # noqa: E402
from roadgeo.sources.osm import stage_elements  # noqa: E402
from roadgeo.sources.scratch import scratch_path  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARMUPS = int(os.environ.get("BENCH_WARMUPS", "1"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
KEEP_TAGS = ("highway", "name", "lit", "surface", "lanes", "ref")

ROAD_QUERIES = {
    "q01": roads.count_roads,
    "q02": roads.road_length,
    "q03": roads.roads_by_highway_type,
    "q04": roads.lit_roads,
    "q05": roads.roads_by_surface,
    "q06": roads.envelope_bbox,
    "q07": roads.major_roads,
    "q08": roads.road_centroids,
    "q09": roads.named_roads_with_lanes,
    "q10": roads.road_statistics,
    "q11": roads.buffer_analysis,
    "q12": roads.spatial_filter,
    "q13": roads.start_end_points,
    "q14": roads.road_complexity,
    "q15": roads.self_join_nearby,
}


def drain(df):
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def nested_loop_pairs(lines):
    """The distance join as one theta join, for comparison at small scale."""
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (a["id"] < b["id"])).select(st_distance("a.geometry", "b.geometry").alias("d"))
    return pairs.filter(f"d < {roads.NEARBY_DISTANCE}")


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("roadgeo-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def once(name, action):
        started = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - started, 3)
        return result

    base = scratch_path(spark, "bench")
    elements = once(
        "stage_elements",
        lambda: stage_elements(derived.elements(spark, SF_DIR), f"{base}/elements"),
    )
    once(
        "build_road_tables",
        lambda: tables.build_road_tables(
            elements, base, "bench", keep_tags=KEEP_TAGS, cluster_cell=0.05
        ),
    )
    ways = tables.read_geometry_parquet(spark, f"{base}/bench_ways.parquet")

    def measure(name, action):
        for _ in range(WARMUPS):
            action()
        taken = []
        for _ in range(RUNS):
            started = time.perf_counter()
            action()
            taken.append(time.perf_counter() - started)
        times[name] = round(sum(taken) / len(taken), 3)

    for name, query in ROAD_QUERIES.items():
        measure(name, lambda: query(ways).collect())
    measure("distance_join_all", lambda: drain(roads.nearby_roads(ways)))
    events = derived.runs(spark, SF_DIR)
    measure("run_box_stats", lambda: runs.run_box_stats(events).collect())
    if os.environ.get("BENCH_NESTED_LOOP"):
        measure("nested_loop", lambda: drain(nested_loop_pairs(ways.filter("tag_name is not null"))))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "road queries on stored tables, total of mean times",
                "value": round(sum(times[q] for q in ROAD_QUERIES), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
