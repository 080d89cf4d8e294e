"""A change log as a data source: segments of JSON lines, read as a table or as a stream by sequence.

    spark.dataSource.register(ChangeLog)
    changes.write.format("changelog").mode("append").save(path)
    spark.read.format("changelog").schema(schema).load(path)
    spark.readStream.format("changelog").schema(schema).load(path)

A segment is a file named by the least and the greatest sequence in it. Tasks write segments beside the log and the commit moves them in, so a
failed write leaves nothing. A stream's offset is a sequence; what lies above it and up to the log's end when a batch is planned is the
batch, a segment a partition. So a stream that begins again after its checkpoint reads each change once, if segments only come in above those that
were there. Paths may be local to a shared folder or addresses that Arrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SUFFIX, STAGED = ".ndjson", "_staged"


@dataclass
class Segment(InputPartition):
    path: str
    above: int
    upto: int | None


@dataclass
class Written(WriterCommitMessage):
    staged: str
    final: str


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """(least, greatest, file) of the log's segments in order."""
    store, root = _store(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.endswith(SUFFIX):
            low, high, _ = info.base_name.split("-", 2)
            found.append((int(low), int(high), info.path))
    return sorted(found)


def _planned(path: str, above: int, upto: int | None) -> list[Segment]:
    return [Segment(file, above, upto) for low, high, file in segments(path) if high > above and (upto is None or low <= upto)]


def _read(path: str, segment: Segment | None, schema: StructType, column: str) -> Iterator[tuple]:
    if segment is None:  # what Spark asks for where there are no partitions
        return
    store, _ = _store(path)
    names = schema.names
    with store.open_input_stream(segment.path) as raw:
        rest = b""
        while chunk := raw.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                row = json.loads(line)
                if row[column] > segment.above and (segment.upto is None or row[column] <= segment.upto):
                    yield tuple(row.get(n) for n in names)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, column: str, above: int):
        self.path, self.schema, self.column, self.above = path, schema, column, above

    def partitions(self) -> list[Segment]:
        return _planned(self.path, self.above, None)

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from _read(self.path, partition, self.schema, self.column)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType, column: str, above: int):
        self.path, self.schema, self.column, self.above = path, schema, column, above

    def initialOffset(self) -> dict:
        return {"sequence": self.above}

    def latestOffset(self) -> dict:
        return {"sequence": max((high for _, high, _ in segments(self.path)), default=self.above)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return _planned(self.path, start["sequence"], end["sequence"])

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from _read(self.path, partition, self.schema, self.column)

    def commit(self, end: dict) -> None:
        """Nothing to do: a log keeps its segments."""


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, column: str):
        self.path, self.schema, self.column = path, schema, column

    def write(self, rows: Iterator) -> Written | None:
        store, root = _store(self.path)
        name = uuid.uuid4().hex
        staged, low, high, out = f"{root}/{STAGED}/{name}", None, None, None
        for row in rows:
            if out is None:
                store.create_dir(f"{root}/{STAGED}", recursive=True)
                out = store.open_output_stream(staged)
            here = row[self.column]
            low, high = here if low is None else min(low, here), here if high is None else max(high, here)
            out.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n")
        if out is None:
            return Written("", "")
        out.close()
        return Written(staged, f"{root}/{low}-{high}-{name}{SUFFIX}")

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and m.staged:
                store.move(m.staged, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None and m.staged and store.get_file_info(m.staged).type == fs.FileType.File:
                store.delete_file(m.staged)


class ChangeLog(DataSource):
    """Options: path; sequence, the column that orders changes (a whole number, `sequence` by default); above, the sequence to begin after."""

    @classmethod
    def name(cls) -> str:
        return "changelog"

    def schema(self) -> str:
        return "sequence long, id string, kind string, payload string"

    def _args(self, schema: StructType) -> tuple[str, StructType, str]:
        return self.options["path"], schema, self.options.get("sequence", "sequence")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(*self._args(schema), int(self.options.get("above", -1)))

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(*self._args(schema), int(self.options.get("above", -1)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("a change log is only appended to")
        return _Writer(*self._args(schema))
