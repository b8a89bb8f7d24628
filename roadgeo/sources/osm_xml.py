"""OSM XML as a Spark data source that splits large files.

A file is cut into byte ranges. The task of a range parses the elements whose start tag begins
inside it, so any number of tasks can share one file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree.ElementTree import XMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader

from roadgeo.sources.files import ELEMENT_BATCH, LOCATION, ByteRanges, ElementReader, open_file
from roadgeo.types import ELEMENTS

ELEMENT_START = re.compile(rb"<(?:node|way|relation)[\s/>]")
DECLARED = re.compile(rb"""(?:\xef\xbb\xbf)?<\?xml[^>]*?\sencoding=["']([A-Za-z][A-Za-z0-9._-]*)["']""")
DECLARATION_BYTES = 200
LONGEST_START = 16  # bytes that may hold a start cut by the end of a read
READ_BYTES = 1 << 20
BATCH_ROWS = 10_000


def _first_start(file, offset: int) -> int | None:
    """Offset of the first element that starts at or after ``offset``."""
    file.seek(offset)
    held = b""
    while True:
        data = file.read(READ_BYTES)
        held += data
        found = ELEMENT_START.search(held)
        if found:
            return offset + found.start()
        if not data:
            return None
        offset += max(len(held) - LONGEST_START, 0)
        held = held[-LONGEST_START:]


def _declaration(file) -> bytes:
    """An XML declaration with the encoding that the file declares. A stretch is parsed by itself and needs it again."""
    file.seek(0)
    declared = DECLARED.match(file.read(DECLARATION_BYTES))
    encoding = declared[1] if declared else b"UTF-8"
    if encoding.upper().replace(b"-", b"").startswith((b"UTF16", b"UTF32", b"UCS")):
        raise ValueError(f"unsupported encoding of XML in ranges: {encoding.decode()}")
    return b'<?xml version="1.0" encoding="' + encoding + b'"?>'


class _Elements:
    """Target of an XML parser: the elements that have ended, as the columns asked for.

    Values go from the parser's callbacks into columns; no tree, event or row is made of them."""

    def __init__(self, kinds: frozenset[str], columns: list[str]):
        self.kinds, self.columns = kinds, columns
        self.tagged, self.located, self.referring, self.typed = (c in columns for c in ("tags", "location", "refs", "ref_types"))
        self.open = [None]  # of each open element: its own kind, attributes, tags and references; None for others
        self._clear()

    def _clear(self) -> None:
        self.ids, self.kind = [], []
        self.keys, self.values, self.tag_ends = [], [], [0]
        self.lon, self.lat = [], []
        self.refs, self.ref_ends = [], [0]
        self.types, self.type_ends = [], [0]

    def new_stretch(self) -> None:
        """A stretch may end inside an element, which goes then."""
        self.open = [None]

    def __len__(self) -> int:
        return len(self.kind)

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        own, parent = None, self.open[-1]
        if tag in self.kinds:
            own = (tag, attributes, [], [])
        elif parent is not None:
            if tag == "tag":
                parent[2].append(attributes)
            elif tag == "nd" and parent[0] == "way" or tag == "member" and parent[0] == "relation":
                parent[3].append(attributes)
        self.open.append(own)

    def end(self, tag: str) -> None:
        own = self.open.pop()
        if own is None:
            return
        kind, attributes, tags, refs = own
        if "id" in self.columns:
            self.ids.append(int(attributes.get("id")))
        self.kind.append(kind)
        if self.tagged:
            for t in tags:
                self.keys.append(t.get("k"))
                self.values.append(t.get("v"))
            self.tag_ends.append(len(self.keys))
        if self.located:
            lon, lat = attributes.get("lon"), attributes.get("lat")
            there = kind == "node" and lon is not None and lat is not None
            self.lon.append(float(lon) if there else None)
            self.lat.append(float(lat) if there else None)
        if self.referring:
            for r in refs:
                self.refs.append(int(r.get("ref")))
            self.ref_ends.append(len(self.refs))
        if self.typed:
            if kind == "relation":
                self.types.extend(r.get("type") for r in refs)
            self.type_ends.append(len(self.types))

    def _column(self, name: str) -> pa.Array:
        if name == "id":
            return pa.array(self.ids, pa.int64())
        kinds = pa.array(self.kind, pa.string())
        if name == "kind":
            return kinds
        if name == "tags":
            return pa.MapArray.from_arrays(pa.array(self.tag_ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        if name == "location":
            lon, lat = pa.array(self.lon, pa.float64()), pa.array(self.lat, pa.float64())
            return pa.StructArray.from_arrays([lon, lat], fields=list(LOCATION), mask=lon.is_null())
        if name == "refs":
            return pa.ListArray.from_arrays(pa.array(self.ref_ends, pa.int32()), pa.array(self.refs, pa.int64()), mask=pc.equal(kinds, "node"))
        return pa.ListArray.from_arrays(pa.array(self.type_ends, pa.int32()), pa.array(self.types, pa.string()), mask=pc.not_equal(kinds, "relation"))

    def batch(self) -> pa.RecordBatch:
        """What has been gathered, which is forgotten."""
        schema = pa.schema([ELEMENT_BATCH.field(c) for c in self.columns])
        found = pa.RecordBatch.from_arrays([self._column(c).cast(schema.field(c).type) for c in self.columns], schema=schema)
        self._clear()
        return found


def _fed(parser: XMLParser, file, begin: int, end: int | None) -> Iterator[None]:
    """Parses a stretch that begins and ends at element starts; stops after each read."""
    parser.feed(_declaration(file) + b"<osm>")
    file.seek(begin)
    left = None if end is None else end - begin
    while left is None or left > 0:
        data = file.read(READ_BYTES if left is None else min(left, READ_BYTES))
        if not data:
            break
        if left is not None:
            left -= len(data)
        parser.feed(data)
        yield


class OsmXmlReader(ElementReader):
    def read(self, partition: ByteRanges):
        elements = _Elements(self.kinds, self.columns)
        for path, begin, end in partition.stretches:
            with open_file(path) as file:
                first = _first_start(file, begin)
                if first is None or first >= end:
                    continue
                elements.new_stretch()
                for _ in _fed(XMLParser(target=elements), file, first, _first_start(file, end)):
                    if len(elements) >= BATCH_ROWS:
                        yield elements.batch()
        if len(elements):
            yield elements.batch()


class OsmXmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roadgeo_osm_xml"

    def schema(self):
        return ELEMENTS

    def reader(self, schema) -> DataSourceReader:
        return OsmXmlReader(self.options, schema.fieldNames())
