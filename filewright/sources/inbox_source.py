"""The inbox as a data source, for files under any name.

Spark's file readers pass over names like ``_plan.txt`` and ``x._COPYING_``. This source reads
every plain file directly inside a folder but dot-files, as a batch or as a stream.

The listing is cut into slices by a checksum of the file name. Each slice is an input partition:
its task walks the folder, keeps the names of its slice and reads their bytes, so no process holds
the listing or the contents of the whole folder, and a lost task is read again from the folder.

A stream goes on by arrival time: the later of modification and, on a local disk, change of the
directory entry, so that moved files count as new. The offset is the latest arrival seen. Files
younger than ``settle`` seconds wait for the next batch, because another file may still appear with the same
time; a file that is changed arrives again.
"""

from __future__ import annotations

import os
import sys
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Readers run in processes that may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "source_path STRING, file_size BIGINT, modified_at TIMESTAMP, content BINARY"
SLICES = 64
BATCH_BYTES, BATCH_FILES = 1 << 24, 1000
LARGEST = (1 << 31) - 1  # bytes in one value


class Found(NamedTuple):
    name: str
    path: str  # as Spark writes it
    size: int
    arrived: int  # nanoseconds


def _local(folder: str) -> str | None:
    """The path on a local disk, or none for a folder in another store."""
    if "://" not in folder and not folder.startswith("file:"):
        return folder
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return None


def listed(folder: str) -> Iterator[Found]:
    """Plain files directly inside a folder but dot-files, in no order; none if it is missing."""
    local = _local(folder)
    if local is None:
        yield from _listed_remotely(folder)
        return
    local = os.path.abspath(local)
    try:
        entries = os.scandir(local)
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            if entry.name.startswith(".") or not entry.is_file():
                continue
            try:
                status = entry.stat()
            except FileNotFoundError:  # moved away meanwhile
                continue
            yield Found(entry.name, f"file:{local}/{entry.name}", status.st_size, max(status.st_mtime_ns, status.st_ctime_ns))


def _listed_remotely(folder: str) -> Iterator[Found]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    base = folder.rstrip("/")
    for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.type == fs.FileType.File and not found.base_name.startswith("."):
            yield Found(found.base_name, f"{base}/{found.base_name}", found.size, found.mtime_ns or 0)


def _content(path: str, size: int) -> bytes | None:
    """The bytes of a file, or none if it cannot be read."""
    if size > LARGEST:
        return None
    try:
        local = _local(path)
        if local is not None:
            with open(local, "rb") as file:
                return file.read()
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inner) as stream:
            return stream.read()
    except OSError:
        return None


class Slice(InputPartition):
    """The files of one slice that arrived after ``since`` and not after ``until``."""

    def __init__(self, number: int, of: int, since: int | None = None, until: int | None = None):
        self.number, self.of, self.since, self.until = number, of, since, until

    def has(self, found: Found) -> bool:
        if self.since is not None and not self.since < found.arrived <= self.until:
            return False
        return zlib.crc32(found.name.encode("utf-8", "surrogateescape")) % self.of == self.number


def _batches(folder: str, part: Slice) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("source_path", pa.string()), ("file_size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("content", pa.binary())]
    )
    rows, held = [], 0
    for found in listed(folder):
        if not part.has(found):
            continue
        content = _content(found.path, found.size)
        arrived = datetime.fromtimestamp(found.arrived / 1e9, timezone.utc)
        rows.append((found.path, found.size if content is None else len(content), arrived, content))
        held += len(content or b"")
        if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


class InboxReader(DataSourceReader):
    def __init__(self, folder: str, slices: int):
        self.folder, self.slices = folder, slices

    def partitions(self) -> list[Slice]:
        return [Slice(number, self.slices) for number in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition)


class InboxStreamReader(DataSourceStreamReader):
    def __init__(self, folder: str, slices: int, settle: float):
        self.folder, self.slices, self.settle = folder, slices, settle
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"arrived": 0}

    def latestOffset(self) -> dict:
        """The latest arrival that has settled; the walk keeps one number."""
        settled = time.time_ns() - int(self.settle * 1e9)
        self.seen = max((found.arrived for found in listed(self.folder) if found.arrived <= settled), default=0) or self.seen
        return {"arrived": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(number, self.slices, start["arrived"], end["arrived"]) for number in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return _batches(self.folder, partition)


class Inbox(DataSource):
    """``spark.read.format("inbox").load(folder)``, with the options ``slices`` and, for streams, ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        return self.options["path"], max(1, int(self.options.get("slices", SLICES)))

    def reader(self, schema) -> InboxReader:
        return InboxReader(*self._options())

    def streamReader(self, schema) -> InboxStreamReader:
        return InboxStreamReader(*self._options(), float(self.options.get("settle", "1")))
