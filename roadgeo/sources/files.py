"""Files as seen by the Python data sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql.datasource import (
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

RANGE_BYTES = 32 << 20  # of a file for one task
KINDS = ("node", "way", "relation")
LOCATION = pa.struct([("longitude", pa.float64()), ("latitude", pa.float64())])

# The element table as Arrow.
ELEMENT_BATCH = pa.schema(
    [
        ("id", pa.int64()),
        ("kind", pa.string()),
        ("tags", pa.map_(pa.string(), pa.string())),
        ("location", LOCATION),
        ("refs", pa.list_(pa.int64())),
        ("ref_types", pa.list_(pa.string())),
    ]
)


def _resolve(path: str):
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_file(path: str):
    """Open a path or URI for random access."""
    system, inner = _resolve(path)
    return system.open_input_file(inner)


def file_sizes(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a directory, but for hidden ones."""
    system, inner = _resolve(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(prefix + info.path, info.size)]

    def shown(found: str) -> bool:
        return not any(part.startswith(("_", ".")) for part in found[len(inner) :].strip("/").split("/"))

    below = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in below if f.type == fs.FileType.File and shown(f.path))


@dataclass
class ByteRanges(InputPartition):
    """Stretches of files, as (path, begin, end), for one task."""

    stretches: tuple

    def __post_init__(self):
        self.value = self.stretches


def byte_ranges(path: str, range_bytes: int) -> list[ByteRanges]:
    """The files of a path in tasks: large files are cut, and small ones put together."""
    out, held, size_held = [], [], 0
    for file, size in file_sizes(path):
        for begin in range(0, size, range_bytes):
            end = min(begin + range_bytes, size)
            if held and size_held + end - begin > range_bytes:
                out.append(ByteRanges(tuple(held)))
                held, size_held = [], 0
            held.append((file, begin, end))
            size_held += end - begin
    return [*out, ByteRanges(tuple(held))]


class ElementReader(DataSourceReader):
    """Reads elements by byte ranges: those of ``kinds``, with the columns asked for.

    Conditions are not taken through ``pushFilters``: Spark 4.1 keeps what it pushed to a Python source with the relation,
    so that two scans of one table with different conditions both got those of the later one.
    """

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.range_bytes, self.columns = options["path"], int(options.get("range_bytes", RANGE_BYTES)), columns
        self.kinds = frozenset(options.get("kinds", ",".join(KINDS)).split(","))

    def partitions(self) -> list[ByteRanges]:
        return byte_ranges(self.path, self.range_bytes)


def exists(path: str) -> bool:
    system, inner = _resolve(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def refuse_existing(path: str) -> None:
    """The error that Spark's own writers give for a target that exists."""
    if exists(path):
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {path} already exists.")


@dataclass
class Part(WriterCommitMessage):
    """The file that a task has written, if it had rows."""

    name: str | None


class PartFiles(DataSourceArrowWriter):
    """Writes a file per task. Files lie in a hidden folder until the job commits, so that neither a failed attempt nor a
    failed job leaves rows that a reader sees.

    A subclass writes the rows of a task with ``fill``.
    """

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path = path.rstrip("/")
        self.overwrite = overwrite
        self.hidden = f"_job-{uuid.uuid4().hex}"

    def fill(self, file, batches: Iterator[pa.RecordBatch]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        number = TaskContext.get().partitionId()
        first = next((b for b in iterator if b.num_rows), None)
        if first is None and number:
            return Part(None)

        def rows():
            if first is not None:
                yield first
                yield from (b for b in iterator if b.num_rows)

        name = f"part-{number:05d}-{uuid.uuid4().hex}{self.suffix}"
        system, inner = _resolve(f"{self.path}/{self.hidden}")
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{name}") as file:
            self.fill(file, rows())
        return Part(name)

    def commit(self, messages) -> None:
        system, inner = _resolve(self.path)
        earlier = file_sizes(self.path) if self.overwrite and exists(self.path) else []
        for m in messages:
            if m is not None and m.name:
                system.move(f"{inner}/{self.hidden}/{m.name}", f"{inner}/{m.name}")
        for file, _ in earlier:
            system.delete_file(_resolve(file)[1])
        self._clear()
        system.open_output_stream(f"{inner}/_SUCCESS").close()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        system, inner = _resolve(f"{self.path}/{self.hidden}")
        if exists(f"{self.path}/{self.hidden}"):
            system.delete_dir(inner)
