"""OSM XML, OSM PBF, GPX, Parquet and JSON, with files written by the tests."""

import bz2
import json
import lzma
import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from roadgeo.functions import st_astext, st_geomfromwkt
from roadgeo.operators import assembly
from roadgeo.sources import pbf, tables
from roadgeo.sources.geoparquet import geo_footers
from roadgeo.sources.gpx import read_gpx
from roadgeo.sources.scratch import scratch_path
from roadgeo.sources.osm import read_osm, read_osm_pbf, read_osm_xml, stage_elements
from roadgeo.sources.pbf_sink import write_osm_pbf
from roadgeo.types import BBOX_COLUMNS, ELEMENTS
from tests import pbf_writer as W

OSM = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6" generator="test">
 <bounds minlat="45" minlon="15" maxlat="46" maxlon="16"/>
 <node id="1" lat="45.8" lon="15.9"/>
 <node id="-2" lat="45.9"
   lon="15.8"><tag k="name" v="A &amp; B &lt;node id=&quot;7&quot;&gt;"/>
  <tag k="place" v="Đurđevac"/></node><node id="3"/>
 <way id="9"><nd ref="1"/><nd ref="-2"/><nd ref="1"/>
   <tag k="highway" v="primary"/></way>
 <way id="10"/>
 <relation id="4"><member type="way" ref="9" role="outer"/><member type="node" ref="1" role=""/>
   <tag k="type" v="route"/></relation>
</osm>
"""


def rows(df):
    """Comparable rows of an element table."""
    return sorted(
        (r["kind"], r["id"], sorted((r["tags"] or {}).items()), r["location"], r["refs"], r["ref_types"])
        for r in df.collect()
    )


@pytest.fixture(scope="module")
def osm_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("osm") / "a.osm"
    path.write_text(OSM, encoding="utf-8")
    return str(path)


def test_osm_xml(spark, osm_file):
    df = read_osm(spark, osm_file)
    assert df.schema == ELEMENTS
    assert rows(df) == [
        ("node", -2, [("name", 'A & B <node id="7">'), ("place", "Đurđevac")], (15.8, 45.9), None, None),
        ("node", 1, [], (15.9, 45.8), None, None),
        ("node", 3, [], None, None, None),
        ("relation", 4, [("type", "route")], None, [9, 1], ["way", "node"]),
        ("way", 9, [("highway", "primary")], None, [1, -2, 1], None),
        ("way", 10, [], None, [], None),
    ]


@pytest.mark.parametrize("range_bytes", [1, 37, 200, 10_000])
def test_osm_xml_splits_anywhere(spark, osm_file, range_bytes):
    from roadgeo.sources.osm_xml import OsmXmlReader

    def parse(size):
        reader = OsmXmlReader({"path": osm_file, "range_bytes": size}, ELEMENTS.fieldNames())
        return [b for p in reader.partitions() for b in reader.read(p)]

    split = [r for b in parse(range_bytes) for r in b.to_pylist()]
    whole = [r for b in parse(1 << 30) for r in b.to_pylist()]
    assert split == whole and len(whole) == 6
    if range_bytes == 200:
        found = read_osm_xml(spark, osm_file, range_bytes)
        assert rows(found) == rows(read_osm(spark, osm_file))


def test_element_starts_are_found_across_reads(tmp_path, monkeypatch):
    from roadgeo.sources import osm_xml

    path = tmp_path / "b.osm"
    path.write_bytes(b"<osm>" + b"".join(b'<node id="%d"/>' % i for i in range(300)) + b"</osm>")
    for read_bytes in (17, 23, 64):
        monkeypatch.setattr(osm_xml, "READ_BYTES", read_bytes)
        reader = osm_xml.OsmXmlReader({"path": str(path), "range_bytes": 101}, ELEMENTS.fieldNames())
        ids = [r["id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert ids == list(range(300))


def test_osm_xml_directory(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / f"{name}.xml").write_text(OSM.replace('id="9"', f'id="{ord(name)}"'), "utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    ids = {r["id"] for r in read_osm_xml(spark, str(tmp_path)).filter("kind = 'way'").collect()}
    assert ids == {ord("x"), ord("y"), 10}


def test_staged_elements(spark, osm_file, tmp_path):
    df = read_osm(spark, osm_file)
    staged = stage_elements(df, str(tmp_path / "e"))
    assert staged.schema == ELEMENTS and rows(staged) == rows(df)
    only = assembly.of_kind(staged, "way")
    assert "PartitionFilters: [isnotnull(kind" in only._jdf.queryExecution().toString()
    lines = assembly.ways(staged).select("id", st_astext("geometry").alias("t")).collect()
    assert [tuple(r) for r in lines] == [(9, "LINESTRING (15.9 45.8, 15.8 45.9, 15.9 45.8)")]


DENSE = [(7, 15.9, 45.8, {}), (5, -15.95, -45.81, {"name": "ž", "lit": "yes"}), (9, 0.0, 0.0, {})]
PLAIN = [(-3, 15.1234567, 45.7654321, {"a": "b"})]
WAYS = [(100, {"highway": "primary"}, [7, 5, 9, 7]), (101, {}, [])]
RELATIONS = [(200, {"type": "route"}, [100, 7, 200], ["way", "node", "relation"])]


def write_pbf(path, *features):
    s, t, u = W.Strings(), W.Strings(), W.Strings()
    groups = [W.dense(s, DENSE), W.plain_nodes(s, PLAIN)]
    coarse = W.dense(u, [(11, 15.9, 45.8, {})], granularity=1000, offset=500)
    rest = [W.ways(t, WAYS), W.relations(t, RELATIONS)]
    path.write_bytes(
        W.header("OsmSchema-V0.6", "DenseNodes", *features)
        + W.block(s, *groups)
        + W.block(t, *rest, compress=False)
        + W.block(u, coarse, granularity=1000, offset=500)
    )
    return str(path)


def test_osm_pbf(spark, tmp_path):
    df = read_osm(spark, write_pbf(tmp_path / "a.osm.pbf"))
    assert df.schema == ELEMENTS
    want = [("node", i, sorted(t.items()), (x, y), None, None) for i, x, y, t in DENSE + PLAIN]
    want.append(("node", 11, [], (15.9000005, 45.8000005), None, None))
    want += [("way", i, sorted(t.items()), None, refs, None) for i, t, refs in WAYS]
    want += [("relation", i, sorted(t.items()), None, r, k) for i, t, r, k in RELATIONS]
    assert rows(df) == sorted(want)


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 301, 10**6])
def test_osm_pbf_is_split_by_bytes(tmp_path, range_bytes):
    path = write_pbf(tmp_path / "a.pbf")
    reader = pbf.OsmPbfReader({"path": path, "range_bytes": range_bytes}, ELEMENTS.fieldNames())
    parts = reader.partitions()
    assert len(parts) == -(-(tmp_path / "a.pbf").stat().st_size // range_bytes)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 8


def test_blob_starts_inside_data_are_not_taken(tmp_path):
    """A raw blob whose text holds the start of a blob."""
    s = W.Strings()
    fake = W.blob(b"OSMData", b"x" * 40)[:30].decode("latin-1")
    inner = W.block(s, W.plain_nodes(s, [(1, 15.0, 45.0, {"note": fake}), (2, 15.0, 45.0, {})]), compress=False)
    (tmp_path / "a.pbf").write_bytes(W.header("OsmSchema-V0.6") + inner + inner)
    reader = pbf.OsmPbfReader({"path": str(tmp_path / "a.pbf"), "range_bytes": 20}, ["id", "tags"])
    ids = [i for p in reader.partitions() for b in reader.read(p) for i in b["id"].to_pylist()]
    assert ids == [1, 2, 1, 2]


def test_cut_pbf_is_an_error(spark, tmp_path):
    path = write_pbf(tmp_path / "a.pbf")
    data = (tmp_path / "a.pbf").read_bytes()
    (tmp_path / "a.pbf").write_bytes(data[:-5])
    with pytest.raises(PySparkException, match="no blob at byte"):
        read_osm(spark, path).collect()


@pytest.mark.parametrize("number", [4, 5, 6, 7])
def test_other_compressions(number):
    data = b"abc" * 100
    packed = {
        4: lzma.compress, 5: bz2.compress, 6: pa.Codec("lz4_raw").compress, 7: pa.Codec("zstd").compress,
    }[number](data)
    assert pbf.inflate(W.field(2, len(data)) + W.field(number, bytes(packed))) == data


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BatchScan")


def test_pbf_scans_are_pruned_by_kind(spark, tmp_path, monkeypatch):
    path = write_pbf(tmp_path / "a.pbf")
    elements = read_osm(spark, path)
    assert rows(elements) == rows(read_osm_pbf(spark, path, by_kind=False))
    assert (scans(elements), scans(elements.filter("kind = 'way'"))) == (3, 1)
    both = elements.filter("kind in ('node', 'relation') and id > 0")
    assert scans(both) == 2 and both.count() == sum(i > 0 for i, *_ in [*DENSE, *PLAIN, (11,), *RELATIONS])
    assert scans(elements.filter("kind = 'other'")) == 0
    # two scans of one table, with different conditions
    pair = elements.filter("kind = 'way'").select("id").unionAll(elements.filter("kind = 'relation'").select("id"))
    assert sorted(r["id"] for r in pair.collect()) == sorted(i for i, *_ in WAYS + RELATIONS)
    narrow = read_osm_pbf(spark, path, columns=["refs", "kind"]).filter("kind = 'way'")
    assert sorted(r["refs"] for r in narrow.collect()) == sorted(refs for _, _, refs in WAYS)
    reader = pbf.OsmPbfReader({"path": path, "kinds": "way"}, ["id", "refs"])
    monkeypatch.setattr(pbf.Block, "_dense", None)
    monkeypatch.setattr(pbf.Block, "_tags", None)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [len(WAYS)]


@pytest.mark.parametrize("encoding", ["ISO-8859-2", "utf-8", "windows-1250"])
def test_xml_encodings(spark, tmp_path, encoding):
    path = tmp_path / "a.osm"
    text = OSM.replace("UTF-8", encoding)
    path.write_bytes(text.encode(encoding))
    utf8 = tmp_path / "b.osm"
    utf8.write_text(OSM, encoding="utf-8")
    for range_bytes in (40, None):
        assert rows(read_osm_xml(spark, str(path), range_bytes)) == rows(read_osm(spark, str(utf8)))


def test_xml_of_two_bytes_is_an_error(spark, tmp_path):
    path = tmp_path / "a.osm"
    path.write_bytes(b'<?xml version="1.0" encoding="UTF-16"?><osm><node id="1" lat="1" lon="2"/></osm>')
    with pytest.raises(PySparkException, match="unsupported encoding"):
        read_osm(spark, str(path)).collect()


def test_xml_columns(spark, tmp_path):
    path = tmp_path / "a.osm"
    path.write_text(OSM)
    narrow = read_osm_xml(spark, str(path), columns=["id", "refs"])
    assert narrow.columns == ["id", "refs"]
    assert sorted((r["id"], r["refs"]) for r in narrow.collect()) == sorted((r[1], r[4]) for r in rows(read_osm(spark, str(path))))


def test_pbf_directories_and_roundtrip(spark, tmp_path):
    elements = read_osm(spark, write_pbf(tmp_path / "a.osm.pbf"))
    no_place = elements.limit(1).selectExpr("cast(77 as bigint) id", "'node' kind", "tags", "cast(null as struct<longitude:double,latitude:double>) location", "refs", "ref_types")
    nulls = elements.limit(1).selectExpr("cast(78 as bigint) id", "'way' kind", "cast(null as map<string,string>) tags", "cast(null as struct<longitude:double,latitude:double>) location", "cast(null as array<bigint>) refs", "cast(null as array<string>) ref_types")
    out = str(tmp_path / "out.osm.pbf")
    write_osm_pbf(elements.unionByName(no_place).unionByName(nulls).repartition(3), out)
    back = read_osm(spark, out)
    assert rows(back) == sorted(rows(elements) + [("way", 78, [], None, [], None)])
    with pytest.raises(AnalysisException, match="PATH_ALREADY_EXISTS"):
        write_osm_pbf(elements, out)
    write_osm_pbf(elements.filter("kind = 'way'"), out, overwrite=True)
    assert rows(read_osm(spark, out)) == rows(elements.filter("kind = 'way'"))
    (tmp_path / "deep.pbf" / "inner").mkdir(parents=True)
    for name in ("a.osm.pbf", "inner/b.osm.pbf", "_hidden", "inner/.c"):
        write_pbf(tmp_path / "deep.pbf" / name)
    assert read_osm(spark, str(tmp_path / "deep.pbf")).count() == 16


def test_pbf_sink_is_given_no_null_lists(spark, tmp_path, monkeypatch):
    """Each null list that an Arrow batch ends with is walked over again at every row after it."""
    from pyspark.sql import DataFrameWriter

    elements = spark.createDataFrame([(1, "node", None, (1.0, 2.0), None, None), (2, "way", None, None, None, None)], ELEMENTS)
    given = []
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, path: given.append(self._df))
    write_osm_pbf(elements, str(tmp_path / "out.pbf"))
    assert [(r["tags"], r["refs"], r["ref_types"]) for r in given[0].collect()] == [({}, [], [])] * 2


def test_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out.pbf")
    bad = read_osm(spark, write_pbf(tmp_path / "a.osm.pbf")).withColumn("id", F.expr("if(kind = 'relation', raise_error('stop'), id)"))
    with pytest.raises(PySparkException):
        write_osm_pbf(bad, out)
    assert not [f for f in Path(out).rglob("*") if f.is_file()]


def test_unknown_pbf_feature_is_an_error(spark, tmp_path):
    with pytest.raises(PySparkException, match="unsupported PBF features"):
        read_osm(spark, write_pbf(tmp_path / "a.pbf", "LocationsOnWays")).collect()


def test_unknown_suffix_is_an_error(spark):
    for path in ("a.json", "a.osm.gz", "a"):
        with pytest.raises(ValueError, match="unsupported file format"):
            read_osm(spark, path)


# ---------------------------------------------------------------- GPX

GPX = """<?xml version="1.0" encoding="UTF-8"?>
<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1">
 <metadata><time>2025-01-01T00:00:00Z</time></metadata>
 <wpt lat="1" lon="2"><name>stop</name></wpt>
 {tracks}
</gpx>
"""
TWO_SEGMENTS = """<trk><name>ring &lt;north&gt; &amp; Öst</name>
 <trkseg><trkpt lat="45.8" lon="15.9"><time>2031-11-17T04:05:06Z</time></trkpt>
  <trkpt lat="45.8" lon="15.9"><time>2031-11-17T04:05:06.250Z</time></trkpt></trkseg>
 <trkseg></trkseg>
 <trkseg><trkpt lat="45.9" lon="15.8"></trkpt></trkseg></trk>"""
UNNAMED = '<trk><trkseg><trkpt lat="1" lon="2"><time>2031-11-17T11:00:00+02:00</time></trkpt></trkseg></trk>'
EMPTY_NAME = '<trk><name></name><trkseg><trkpt lat="3" lon="4"/></trkseg></trk>'


@pytest.fixture(scope="module")
def gpx_dir(tmp_path_factory):
    path = tmp_path_factory.mktemp("gpx")
    (path / "one.gpx").write_text(GPX.format(tracks=TWO_SEGMENTS + UNNAMED), "utf-8")
    (path / "my 1+1 track.v2.gpx").write_text(GPX.format(tracks=EMPTY_NAME), "utf-8")
    (path / "none.gpx").write_text(GPX.format(tracks=""), "utf-8")
    (path / "notes.xml").write_text(GPX.format(tracks=UNNAMED), "utf-8")
    return str(path)


def test_gpx(spark, gpx_dir):
    df = read_gpx(spark, gpx_dir)
    assert df.columns == ["lat", "lon", "track", "time", "geometry", "file", "seg", "pos"]
    utc = "date_format(time, 'HH:mm:ss.SSS') AS time"
    got = df.selectExpr("track", "seg", "pos", "lat", "lon", utc, "file").collect()
    name = "ring <north> & Öst"
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            (name, 0, 0, 45.8, 15.9, "04:05:06.000", "one.gpx"),
            (name, 0, 1, 45.8, 15.9, "04:05:06.250", "one.gpx"),
            (name, 2, 0, 45.9, 15.8, None, "one.gpx"),
            ("one", 0, 0, 1.0, 2.0, "09:00:00.000", "one.gpx"),
            ("my 1+1 track.v2", 0, 0, 3.0, 4.0, None, "my 1+1 track.v2.gpx"),
        ],
        key=str,
    )
    assert df.select(st_astext("geometry")).distinct().count() == 4


def test_dataset_by_format(spark, gpx_dir, tmp_path):
    tables.read_dataset(spark, gpx_dir, "gpx", "vehicles")
    assert spark.sql("SELECT count(*) AS n FROM vehicles WHERE lat > 45").first()["n"] == 3
    with pytest.raises(ValueError, match="unsupported format"):
        tables.read_dataset(spark, gpx_dir, "csv", "x")


# ---------------------------------------------------------------- Parquet and JSON


@pytest.fixture(scope="module")
def lines(spark, osm_file):
    return assembly.ways(read_osm(spark, osm_file)).cache()


@pytest.mark.parametrize("encoding", ["struct", "wkb"])
def test_geometry_parquet(spark, lines, tmp_path, encoding):
    path = str(tmp_path / "ways")
    tables.write_geometry_parquet(lines, path, encoding=encoding, keep_tags=["highway"], cluster_cell=0.1)
    back = tables.read_geometry_parquet(spark, path)
    assert back.columns == ["id", "tags", "geometry", *BBOX_COLUMNS, "n_points", "tag_highway"]
    row = back.first()
    assert row["geometry"] == lines.first()["geometry"]
    assert tuple(row[3:]) == (15.8, 45.8, 15.9, 45.9, 3, "primary")
    with pytest.raises(AnalysisException):
        tables.write_geometry_parquet(lines, path)
    tables.write_geometry_parquet(lines, path, overwrite=True)


def shapes(spark):
    texts = ["POINT (1 2)", "LINESTRING (0 0, 3 4)", "POLYGON ((0 0, 4 0, 4 4, 0 0))", None, "POINT EMPTY"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, wkt string")
    return df.select("id", st_geomfromwkt(F.col("wkt")).alias("geometry"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"))


def test_geoparquet_footers(spark, tmp_path):
    path = str(tmp_path / "shapes")
    tables.write_geometry_parquet(shapes(spark).repartition(3, "id"), path, encoding="wkb")
    files = [p for p in Path(path).iterdir() if p.suffix == ".parquet"]
    seen, held = set(), 0
    for file in files:
        geo = json.loads(pq.read_metadata(file).metadata[b"geo"])
        column = geo["columns"]["geometry"]
        rows = pq.read_table(file)
        boxes = rows.select(list(BBOX_COLUMNS)).to_pandas().dropna()
        assert (geo["version"], geo["primary_column"], column["encoding"]) == ("1.1.0", "geometry", "WKB")
        if len(boxes):
            assert column["bbox"] == [*boxes.min()[:2], *boxes.max()[2:]]
        else:
            assert "bbox" not in column
        seen |= set(column["geometry_types"])
        held += rows.num_rows
    assert (seen, held) == ({"Point", "LineString", "Polygon"}, 5)
    assert not [p for p in Path(path).iterdir() if p.name.startswith("_job")]
    back = tables.read_geometry_parquet(spark, path)
    plain = {r["id"]: r["geometry"] for r in shapes(spark).collect()}
    assert {r["id"]: r["geometry"] for r in back.collect()} == plain
    assert geo_footers(spark, path).count() == len(files)


def test_geoparquet_sink_is_given_no_null_lists(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    places = shapes(spark).select("id", "geometry", F.expr("if(id < 3, null, if(id < 4, map(), tags)) AS tags"), F.expr("if(id = 1, null, array(id)) AS ids"))
    tables.write_geometry_parquet(places, str(tmp_path / "shapes"), encoding="wkb")
    back = tables.read_geometry_parquet(spark, str(tmp_path / "shapes"))
    assert set(back.columns) == {*places.columns, *BBOX_COLUMNS, "n_points"}
    found = {r["id"]: (r["tags"], r["ids"]) for r in back.collect()}
    assert found == {0: (None, [0]), 1: (None, None), 2: (None, [2]), 3: ({}, [3]), 4: ({"a": "b"}, [4])}

    given = []
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, path: given.append(self._df))
    tables.write_geometry_parquet(places, str(tmp_path / "more"), encoding="wkb")
    assert all(r["tags"] is not None and r["ids"] is not None for r in given[0].collect())


def test_geoparquet_without_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    tables.write_geometry_parquet(shapes(spark).limit(0), path, encoding="wkb")
    assert tables.read_geometry_parquet(spark, path).count() == 0


@pytest.mark.parametrize(
    "encoding,value,kind",
    [
        ("point", {"x": 1.0, "y": 2.0}, "POINT (1 2)"),
        ("linestring", [{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}], "LINESTRING (0 0, 3 4)"),
        ("polygon", [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]], "POLYGON ((0 0, 4 0, 4 4, 0 0))"),
        ("multipoint", [{"x": 0.0, "y": 0.0}], None),
    ],
)
def test_geoparquet_of_others(spark, tmp_path, encoding, value, kind):
    """Another name for the primary column, and encodings without well-known binary."""
    geo = {"version": "1.1.0", "primary_column": "geom", "columns": {"geom": {"encoding": encoding, "geometry_types": []}}}
    table = pa.table({"name": ["a", "b"], "geom": [value, None]}).replace_schema_metadata({"geo": json.dumps(geo)})
    pq.write_table(table, tmp_path / "a.parquet")
    if kind is None:
        with pytest.raises(ValueError, match="unsupported geometry encoding"):
            tables.read_geometry_parquet(spark, str(tmp_path / "a.parquet"))
        return
    back = tables.read_geometry_parquet(spark, str(tmp_path / "a.parquet"))
    assert back.columns == ["name", "geometry"]
    assert [r[0] for r in back.select(st_astext("geometry")).collect()] == [kind, None]


def test_other_geometry_types_are_errors(spark, tmp_path):
    spark.range(1).withColumn("geometry", F.lit("POINT(1 2)")).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="not a geometry column"):
        tables.read_geometry_parquet(spark, str(tmp_path / "t"))
    spark.range(1).write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="no geometry column"):
        tables.read_geometry_parquet(spark, str(tmp_path / "n"))


def test_wkb_export(spark, lines, tmp_path):
    path = str(tmp_path / "export")
    tables.export_wkb(lines, path)
    assert spark.read.parquet(path).dtypes == [
        ("osm_id", "bigint"), ("tags", "map<string,string>"), ("geometry", "binary"),
    ]
    with pytest.raises(AnalysisException):
        tables.export_wkb(lines, path)
    tables.export_wkb(lines, path, overwrite=True)


def test_result_json(spark, lines, tmp_path):
    tables.write_result_json(lines, str(tmp_path / "plain"))
    assert spark.read.json(str(tmp_path / "plain")).columns == ["id", "tags"]
    tables.write_result_json(lines, str(tmp_path / "text"), geometry="wkt")
    assert spark.read.json(str(tmp_path / "text")).first()["geometry"].startswith("LINESTRING (")
    with pytest.raises(ValueError):
        tables.result_columns(lines, "svg")


def test_road_tables(spark, osm_file, tmp_path):
    dropped = tables.build_road_tables(read_osm(spark, osm_file), str(tmp_path), "a")
    assert dropped == {
        "nodes_without_location": 1, "ways_without_refs": 1, "ways_with_one_vertex": 0,
    }
    assert sorted(os.listdir(tmp_path)) == ["a_points.parquet", "a_ways.parquet"]
    assert spark.read.parquet(str(tmp_path / "a_points.parquet")).count() == 2
    with pytest.raises(PySparkException, match="node without location: 3"):
        tables.build_road_tables(read_osm(spark, osm_file), str(tmp_path), "b", strict=True)


def test_drop_counts_do_not_depend_on_clustering(spark, osm_file, tmp_path):
    elements = read_osm(spark, osm_file)
    plain = tables.build_road_tables(elements, str(tmp_path / "plain"), "a")
    assert tables.build_road_tables(elements, str(tmp_path / "laid"), "a", cluster_cell=0.05) == plain
    assert {p.name for p in (tmp_path / "laid").iterdir()} == {"a_points.parquet", "a_ways.parquet"}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session(), "x")


def test_z_order_keeps_neighbours_together(spark):
    cells = spark.createDataFrame([(float(x), float(y)) for x in range(-4, 4) for y in range(-4, 4)], "x double, y double")
    order = cells.select("x", "y", tables.z_order(F.col("x"), F.col("y"), 1.0).alias("z")).orderBy("z")
    got = [(int(r["x"]), int(r["y"])) for r in order.collect()]
    assert len(set(got)) == 64 and set(got[:4]) == {(-4, -4), (-3, -4), (-4, -3), (-3, -3)}


def test_osm_xml_columns_without_a_tree(tmp_path, monkeypatch):
    """Elements become columns while they are read, without an object of the tree each; odd nesting, entities and absent attributes included."""
    from xml.etree import ElementTree

    from roadgeo.sources import osm_xml

    monkeypatch.setattr(osm_xml, "XMLPullParser", None, raising=False)
    path = tmp_path / "odd.osm"
    path.write_text(
        '<osm><node id="1" lat="1" lon="2"/><node id="2" lat="3"><tag k="a" v="&amp;&#233;"/><tag k="b"/><nd ref="4"/>'
        '<tag k="x" v="y"><tag k="in" v="in"/></tag></node><way id="3"><nd ref="1"/><nd ref=" 2 "/><member ref="9"/>'
        '<node id="7" lon="1" lat="2"><tag k="n" v="m"/></node></way><way id="4"/>'
        '<relation id="5"><member type="way" ref="3"/><member ref="4"/></relation><z:node xmlns:z="q" id="8"/><way id="9"><nd ref="1"/>'
    )

    def read(columns, **options):
        reader = osm_xml.OsmXmlReader({"path": str(path), **options}, columns)
        return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]

    at = lambda lon, lat: {"longitude": lon, "latitude": lat}
    names = ["id", "kind", "tags", "location", "refs", "ref_types"]
    want = [
        (1, "node", [], at(2.0, 1.0), None, None),
        (2, "node", [("a", "&é"), ("b", None), ("x", "y")], None, None, None),
        (7, "node", [("n", "m")], at(1.0, 2.0), None, None),
        (3, "way", [], None, [1, 2], None),
        (4, "way", [], None, [], None),
        (5, "relation", [], None, [3, 4], ["way", None]),
    ]
    assert [tuple(r[c] for c in names) for r in read(names)] == want
    assert read(["refs", "id"], kinds="way") == [{"refs": [1, 2], "id": 3}, {"refs": [], "id": 4}]
    monkeypatch.setattr(osm_xml, "BATCH_ROWS", 1)
    monkeypatch.setattr(osm_xml, "READ_BYTES", 40)
    assert [tuple(r[c] for c in names) for r in read(names)] == want
    path.write_text("<osm><node id='1'></way></osm>")
    with pytest.raises(ElementTree.ParseError):
        read(names)
