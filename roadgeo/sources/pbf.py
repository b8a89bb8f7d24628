"""OSM PBF as a Spark data source.

Files are cut into byte ranges without being opened. The task of a range looks for the first blob that starts in it, and
reads blobs until one starts beyond it. Groups of kinds that are not asked for are passed over, and columns that are not
asked for are not decoded.
"""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from roadgeo.sources import wire
from roadgeo.sources.files import ELEMENT_BATCH, LOCATION, ByteRanges, ElementReader, open_file
from roadgeo.types import ELEMENTS

# Fixed values of the PBF format.
MEMBER_TYPES = ("node", "way", "relation")
KNOWN_FEATURES = {"OsmSchema-V0.6", "DenseNodes", "HistoricalInformation"}
DEFAULT_GRANULARITY = 100
DEGREE = 1e-9
LARGEST_HEADER, LARGEST_BLOB = 64 << 10, 32 << 20
#: A blob starts with the size of its header, whose first field is the kind of blob.
BLOB_START = re.compile(rb"(?=\x00[\x00\x01]..\n(?:\x07OSMData|\x09OSMHeader))", re.DOTALL)
START_BYTES = 16  # that the pattern may look at

READ_BYTES = 1 << 20
#: Blobs that have to follow each other before a place is taken for the start of one.
CHAIN = 3

# ---------------------------------------------------------------- blobs


def _blob(file, pos: int, size: int) -> tuple[str, int, int] | None:
    """Kind, start and end of the blob whose header starts at ``pos``; None if no blob can start there."""
    file.seek(pos)
    head = file.read(4)
    if len(head) < 4 or (n := struct.unpack(">I", head)[0]) > LARGEST_HEADER:
        return None
    head = file.read(n)
    try:
        part = {number: (head[a:b], a) for number, a, b in wire.spans(head, 0, len(head))}
        kind, length = part[1][0].decode("ascii"), part[3][1]
    except (ValueError, IndexError, KeyError):
        return None
    start = pos + 4 + n
    if len(head) < n or not 0 <= length <= LARGEST_BLOB or start + length > size:
        return None
    return kind, start, start + length


def _is_start(file, pos: int, size: int) -> bool:
    for _ in range(CHAIN):
        if pos == size:
            return True
        found = _blob(file, pos, size)
        if found is None:
            return False
        pos = found[2]
    return True


def first_blob(file, begin: int, size: int) -> int | None:
    """The first place at or after ``begin`` where a blob starts."""
    if begin == 0:
        return 0
    offset, held = begin, b""
    while offset + len(held) < size:
        file.seek(offset + len(held))
        held += file.read(READ_BYTES)
        for match in BLOB_START.finditer(held):
            if _is_start(file, offset + match.start(), size):
                return offset + match.start()
        keep = held[-START_BYTES + 1 :]
        offset, held = offset + len(held) - len(keep), keep
        if offset + len(held) >= size:
            return None
    return None


def blobs(path: str, begin: int, end: int) -> Iterator[bytes]:
    """Data blobs that start in a range. The header blob is checked by the task that meets it."""
    with open_file(path) as file:
        size = file.size()
        pos = first_blob(file, begin, size)
        while pos is not None and pos < min(end, size):
            found = _blob(file, pos, size)
            if found is None:
                raise ValueError(f"no blob at byte {pos} of {path}")
            kind, start, pos = found
            if kind in ("OSMHeader", "OSMData"):
                file.seek(start)
                blob = file.read(pos - start)
                if kind == "OSMData":
                    yield blob
                else:
                    _check_header(inflate(blob))


def inflate(blob: bytes) -> bytes:
    """The content of a blob, whichever way it is compressed."""
    part = {number: blob[a:b] if b >= 0 else a for number, a, b in wire.spans(blob, 0, len(blob))}
    if 1 in part:
        return part[1]
    if 3 in part:
        return zlib.decompress(part[3])
    if 4 in part:
        return lzma.decompress(part[4])
    if 5 in part:
        return bz2.decompress(part[5])
    for number, codec in ((6, "lz4_raw"), (7, "zstd")):
        if number in part:
            return pa.Codec(codec).decompress(part[number], part[2], asbytes=True)
    raise ValueError("a blob without data")


def _check_header(data: bytes) -> None:
    required = {data[a:b].decode() for n, a, b in wire.spans(data, 0, len(data)) if n == 4}
    if required - KNOWN_FEATURES:
        raise ValueError(f"unsupported PBF features: {sorted(required - KNOWN_FEATURES)}")


# ---------------------------------------------------------------- blocks to Arrow


def _offsets(counts) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


class Block:
    """One primitive block: its strings and coordinate scale, and its groups as batches of the wanted kinds and columns."""

    def __init__(self, data: bytes, kinds: frozenset[str], columns: list[str]):
        self.kinds, self.columns = kinds, columns
        self.raw, self.data = data, np.frombuffer(data + bytes(wire.PAD), np.uint8)
        self.groups, self.granularity, self.lat_offset, self.lon_offset = [], DEFAULT_GRANULARITY, 0, 0
        strings = None
        for number, a, b in wire.spans(data, 0, len(data)):
            if number == 1:
                strings = (a, b)
            elif number == 2:
                self.groups.append((a, b))
            elif number == 17:
                self.granularity = a
            elif number == 19:
                self.lat_offset = wire.int64(a)
            elif number == 20:
                self.lon_offset = wire.int64(a)
        texts = [data[a:b].decode("utf-8", "replace") for n, a, b in wire.spans(data, *strings) if n == 1] if strings and "tags" in columns else []
        self.strings = pa.array(texts, pa.string())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for group in self.groups:
            found: dict[int, list[tuple[int, int]]] = {}
            for number, a, b in wire.spans(self.raw, *group):
                if number in (1, 2) and "node" not in self.kinds or number == 3 and "way" not in self.kinds:
                    break  # a group holds one kind
                found.setdefault(number, []).append((a, b))
            for number, places in found.items():
                if number == 2:
                    for place in places:
                        yield self._dense(wire.Messages(self.data, [place[0]], [place[1]]))
                elif number in (1, 3) or number == 4 and "relation" in self.kinds:
                    make = {1: self._nodes, 3: self._ways, 4: self._relations}[number]
                    yield make(wire.Messages(self.data, *zip(*places)))

    def _batch(self, kind: str, n: int, **columns) -> pa.RecordBatch:
        """The wanted columns; each is given as a function, and called if it is wanted."""
        wanted = [ELEMENT_BATCH.field(c) for c in self.columns]
        columns |= {"kind": lambda: pa.repeat(kind, n)}
        filled = [columns[f.name]().cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in wanted]
        return pa.RecordBatch.from_arrays(filled, schema=pa.schema(wanted))

    def _texts(self, counts, keys, values) -> pa.Array:
        key, value = (self.strings.take(pa.array(x.astype(np.int64))) for x in (keys, values))
        return pa.MapArray.from_arrays(_offsets(counts), key, value)

    def _tags(self, messages: wire.Messages) -> pa.Array:
        keys = messages.lists(2)
        return self._texts(keys.counts, keys.values, messages.lists(3).values)

    def _location(self, lat: np.ndarray, lon: np.ndarray) -> pa.Array:
        x = (self.lon_offset + self.granularity * lon) * DEGREE
        y = (self.lat_offset + self.granularity * lat) * DEGREE
        # nanodegrees as the nearest decimal, so that 15.95 does not become 15.950000000000001
        return pa.StructArray.from_arrays([pa.array(np.round(x, 9)), pa.array(np.round(y, 9))], fields=list(LOCATION))

    def _dense(self, message: wire.Messages) -> pa.RecordBatch:
        ids = message.lists(1).running()

        def tags() -> pa.Array:
            stream = message.lists(10).values
            if not len(stream):
                return self._texts(np.zeros(len(ids), np.int64), stream, stream)
            # key, value, key, value, 0 for each node; the string 0 is reserved, so every zero ends a node
            ends = np.flatnonzero(stream == 0)
            body = np.delete(stream, ends)
            return self._texts(np.diff(ends, prepend=-1) // 2, body[0::2], body[1::2])

        return self._batch(
            "node", len(ids), id=lambda: pa.array(ids), tags=tags,
            location=lambda: self._location(message.lists(8).running(), message.lists(9).running()),
        )

    def _nodes(self, messages: wire.Messages) -> pa.RecordBatch:
        return self._batch(
            "node", messages.n, id=lambda: pa.array(wire.signed(messages.plain(1))), tags=lambda: self._tags(messages),
            location=lambda: self._location(wire.signed(messages.plain(8)), wire.signed(messages.plain(9))),
        )

    def _ways(self, messages: wire.Messages) -> pa.RecordBatch:
        def refs() -> pa.Array:
            lists = messages.lists(8)
            return pa.ListArray.from_arrays(_offsets(lists.counts), pa.array(lists.running()))

        return self._batch("way", messages.n, id=lambda: pa.array(messages.plain(1).astype(np.int64)), tags=lambda: self._tags(messages), refs=refs)

    def _relations(self, messages: wire.Messages) -> pa.RecordBatch:
        members = messages.lists(9)

        def types() -> pa.Array:
            names = pa.array(MEMBER_TYPES).take(pa.array(messages.lists(10).values.astype(np.int64)))
            return pa.ListArray.from_arrays(_offsets(members.counts), names)

        return self._batch(
            "relation", messages.n, id=lambda: pa.array(messages.plain(1).astype(np.int64)), tags=lambda: self._tags(messages),
            refs=lambda: pa.ListArray.from_arrays(_offsets(members.counts), pa.array(members.running())), ref_types=types,
        )


# ---------------------------------------------------------------- data source


class OsmPbfReader(ElementReader):
    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for path, begin, end in partition.stretches:
            for blob in blobs(path, begin, end):
                yield from Block(inflate(blob), self.kinds, self.columns).batches()


class OsmPbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roadgeo_osm_pbf"

    def schema(self):
        return ELEMENTS

    def reader(self, schema) -> DataSourceReader:
        return OsmPbfReader(self.options, schema.fieldNames())
