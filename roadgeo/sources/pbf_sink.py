"""OSM PBF as a Spark data sink: a directory with a file per task, in the form that the source reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

from roadgeo.sources.files import PartFiles, refuse_existing
from roadgeo.sources.pbf import MEMBER_TYPES
from roadgeo.sources.wire import Pieces, differences, plain_field, zigzag
from roadgeo.types import ELEMENTS

#: Elements of a block, and the unit of its coordinates: one nanodegree.
BLOCK_ROWS, GRANULARITY = 8000, 1


def _one(raw: bytes | np.ndarray) -> Pieces:
    data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    return Pieces(data, np.array([len(data)]))


def _whole(pieces: Pieces, number: int) -> Pieces:
    """All strings together, as one field."""
    return _one(pieces.raw).field(number)


def _blob(kind: bytes, content: bytes) -> bytes:
    body = bytes(plain_field(2, [len(content)])) + bytes(_one(zlib.compress(content)).field(3))
    head = bytes(_one(kind).field(1)) + bytes(plain_field(3, [len(body)]))
    return struct.pack(">I", len(head)) + head + body


def _counts(column: pa.Array) -> np.ndarray:
    """How many entries each row of a list or map column has; null rows have none."""
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0).astype(np.int64)


class _Strings:
    """The strings of a block, from 1."""

    def __init__(self, texts: pa.Array):
        self.known = pc.unique(texts)

    def places(self, texts: pa.Array) -> np.ndarray:
        return pc.index_in(texts, self.known).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def message(self) -> Pieces:
        texts = [b"", *(t.encode() for t in self.known.to_pylist())]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        keys = Pieces.numbers(np.full(len(texts), 1 << 3 | 2))
        return keys.then(Pieces.numbers(lengths), Pieces(raw, lengths))


def block(batch: pa.RecordBatch) -> bytes:
    """A block of elements of one kind."""
    kind, ids = batch["kind"][0].as_py(), batch["id"].to_numpy()
    tags, counts = batch["tags"], _counts(batch["tags"])
    keys, values = tags.keys, pc.fill_null(tags.items, "")
    strings = _Strings(pa.concat_arrays([keys, values]))
    k, v = strings.places(keys), strings.places(values)
    if kind == "node":
        group = _dense(batch, ids, k, v, counts)
    else:
        packed = Pieces.numbers(k).grouped(counts).field(2).then(Pieces.numbers(v).grouped(counts).field(3))
        members, n = batch["refs"].flatten().to_numpy(), _counts(batch["refs"])
        steps = Pieces.numbers(zigzag(differences(members, n))).grouped(n)
        own = plain_field(1, ids.astype(np.int64).view(np.uint64)).then(packed)
        if kind == "way":
            group = _messages(own.then(steps.field(8)), 3)
        else:
            types = pc.index_in(batch["ref_types"].flatten(), pa.array(MEMBER_TYPES)).to_numpy()
            roles = Pieces.numbers(np.zeros(len(members))).grouped(n)
            group = _messages(own.then(roles.field(8), steps.field(9), Pieces.numbers(types).grouped(n).field(10)), 4)
    return bytes(_whole(strings.message(), 1)) + bytes(_one(group).field(2)) + bytes(plain_field(17, [GRANULARITY]))


def _messages(pieces: Pieces, number: int) -> bytes:
    """Messages as repeated fields; each has an id, so none is empty."""
    return bytes(pieces.field(number))


def _dense(batch: pa.RecordBatch, ids: np.ndarray, k: np.ndarray, v: np.ndarray, counts: np.ndarray) -> bytes:
    all_ = np.array([len(ids)])
    location = batch["location"]
    units = {c: np.round(location.field(c).to_numpy() * (1e9 / GRANULARITY)).astype(np.int64) for c in ("latitude", "longitude")}
    columns = [(1, ids), (8, units["latitude"]), (9, units["longitude"])]
    out = b"".join(bytes(_whole(Pieces.numbers(zigzag(differences(c, all_))), n)) for n, c in columns)
    if len(k):
        stream = np.zeros(2 * len(k) + len(ids), np.int64)
        ends = 2 * np.cumsum(counts) + np.arange(len(ids))
        inner = np.delete(np.arange(len(stream)), ends)
        stream[inner[0::2]], stream[inner[1::2]] = k, v
        out += bytes(_whole(Pieces.numbers(stream), 10))
    return bytes(_one(out).field(2))


class OsmPbfWriter(PartFiles):
    suffix = ".osm.pbf"

    def fill(self, file, batches: Iterator[pa.RecordBatch]) -> None:
        features = b"".join(bytes(_one(f).field(4)) for f in (b"OsmSchema-V0.6", b"DenseNodes"))
        file.write(_blob(b"OSMHeader", features))
        for batch in batches:
            for kind in MEMBER_TYPES:
                own = batch.filter(pc.equal(batch["kind"], kind))
                for start in range(0, own.num_rows, BLOCK_ROWS):
                    # taken, not sliced, so that the offsets of nested columns start at zero
                    rows = pa.array(np.arange(start, min(start + BLOCK_ROWS, own.num_rows)))
                    file.write(_blob(b"OSMData", block(own.take(rows))))


class OsmPbfSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "roadgeo_osm_pbf_sink"

    def schema(self):
        return ELEMENTS

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return OsmPbfWriter(self.options["path"], overwrite)


def _present(field) -> Column:
    """A column of the elements. The format knows no null lists, so they go as empty ones: after each row that Spark hands to
    Python it walks over all the null lists that its Arrow batch ends with, which takes the square of a batch's rows."""
    empty = {"array": F.array, "map": F.create_map}.get(field.dataType.typeName())
    column = F.col(field.name).cast(field.dataType)
    return F.coalesce(column, empty().cast(field.dataType)) if empty else column


def write_osm_pbf(elements: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write elements as PBF files in a directory; an existing target is an error unless ``overwrite``.

    Coordinates are kept to a nanodegree. The format knows no node without a location, so these are left out.
    """
    if not overwrite:
        refuse_existing(path)
    elements.sparkSession.dataSource.register(OsmPbfSink)
    known = elements.filter((F.col("kind") != "node") | F.col("location").isNotNull())
    columns = known.select(*(_present(f).alias(f.name) for f in ELEMENTS.fields))
    columns.write.format(OsmPbfSink.name()).mode("overwrite" if overwrite else "append").save(path)
