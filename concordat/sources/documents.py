"""Multi-document YAML files as a data source, in batches and as a stream.

A row per document: the file (``source``), the byte at which the document begins (``place``)
and its text (``descriptor``), as ``parse_descriptors`` takes it.  A large file is read by many
tasks: each takes a range of bytes and reads the documents that begin in it, to their ends.
Only one document is held at a time.

The stream follows a folder.  What it has found is written down in a log of its own, an entry
per listing that found new files, and an offset is a number of entries; a restart reads the
log and goes on.  Files are written once, under names without a leading ``_`` or ``.``.  A run
of what is there now (``availableNow``) that finds a stopped batch does that batch again, and
what came in since is the next run's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from concordat.sources.stores import carried, listed, opened

# A marker line: three hyphens at the start of a line, then white space or the end.
_MARKER = re.compile(rb"\n---(?=[ \t\r\n]|\Z)")
_CONTENT = re.compile(rb"(?m)^(?![ \t\r]*(?:#|$)|%)")
_CHUNK = 1 << 20


class Range(InputPartition):
    """Some bytes of some files: (source, path, start, stop)."""

    def __init__(self, parts: list[tuple[str, str, int, int]]) -> None:
        self.parts = parts


def documents(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the documents that begin from ``start`` on and before ``stop``.

    The marker belongs to the document behind it.  What is ahead of a file's first marker is a
    document if it has any content; an empty one between two markers is a document too.
    """
    # a line end is imagined ahead of the file, so that every marker follows one
    base = start - 1
    buffer = bytearray(b"\n") if start == 0 else bytearray()
    file.seek(max(base, 0))
    ended = False

    def more() -> None:
        nonlocal ended
        chunk = file.read(_CHUNK)
        ended = not chunk
        buffer.extend(chunk)

    def marker(at: int) -> int:
        """The next marker's place in the buffer, its end if there is none."""
        while True:
            found = _MARKER.search(buffer, at)
            if found and (ended or found.end() < len(buffer)):
                return found.start()
            if ended:
                return len(buffer)
            at = max(at, len(buffer) - 4)
            more()

    def skipped() -> int:
        """The first marker from here on; what lies ahead of it is another range's and not kept."""
        nonlocal base
        while True:
            found = _MARKER.search(buffer)
            if found and (ended or found.end() < len(buffer)):
                return found.start()
            if ended or base + len(buffer) - 4 >= stop:
                return len(buffer)
            gone = max(0, len(buffer) - 4)
            del buffer[:gone]
            base += gone
            more()

    if start == 0:
        at = marker(0)
        head = bytes(buffer[1:at])
        if _CONTENT.search(head):
            yield 0, head
    else:
        at = skipped()
    while at < len(buffer) and base + at + 1 < stop:
        del buffer[:at]
        base += at
        at = marker(4)
        yield base + 1, bytes(buffer[4:at])


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._path, self._size = options["path"], int(options.get("rangebytes", str(64 << 20)))

    def partitions(self) -> list[InputPartition]:
        return _ranges(_files(self._path), self._size)

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from _read(partition)


class DocumentStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._path, self._log, self._size = options["path"], options["log"], int(options.get("rangebytes", str(64 << 20)))
        self._known: set[str] = set()
        self._entries = 0

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        while (entry := self._entry(self._entries)) is not None:  # of earlier runs
            self._known.update(source for source, _, _ in entry)
            self._entries += 1
        new = [f for f in _files(self._path) if f[0] not in self._known]
        if new:
            fs, log = opened(self._log)
            fs.create_dir(log)
            with fs.open_output_stream(f"{log}/_writing") as out:
                out.write(json.dumps(new).encode())
            fs.move(f"{log}/_writing", f"{log}/{self._entries}.json")
            self._known.update(source for source, _, _ in new)
            self._entries += 1
        return {"entries": self._entries}

    def _entry(self, number: int) -> list | None:
        import pyarrow.fs as pafs

        fs, log = opened(self._log)
        path = f"{log}/{number}.json"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(path) as file:
            return json.loads(file.read())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = [tuple(f) for n in range(start["entries"], end["entries"]) for f in self._entry(n)]
        return _ranges(files, self._size)

    def read(self, partition: Range) -> Iterator[tuple]:
        yield from _read(partition)


def _files(location: str) -> list[tuple[str, str, int]]:
    """(source, path, bytes) of every file below a location."""
    import pyarrow.fs as pafs

    _, found = listed(location, recursive=True)
    ahead = location[: len(location) - len(opened(location)[1])] if "://" in location else ""
    return [(ahead + i.path, i.path, i.size) for i in found if i.type == pafs.FileType.File]


def _ranges(files: list[tuple[str, str, int]], size: int) -> list[InputPartition]:
    """Ranges of about ``size`` bytes: a large file makes many, small ones share one."""
    out, held, room = [], [], size
    for source, path, length in files:
        for start in range(0, length, size):
            part = (source, path, start, min(length, start + size))
            if held and part[3] - start > room:
                out.append(Range(held))
                held, room = [], size
            held.append(part)
            room -= part[3] - start
    return [*out, Range(held)] if held else out


def _read(partition: Range | None) -> Iterator[tuple]:
    for source, path, start, stop in partition.parts if partition else []:
        fs, _ = opened(source)
        with fs.open_input_file(path) as file:
            for place, text in documents(file, start, stop):
                yield source, place, text.decode("utf-8", "replace").removeprefix("﻿")


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yaml_documents"

    def schema(self) -> str:
        return "source string, place bigint, descriptor string"

    def reader(self, schema: T.StructType) -> DocumentReader:
        return DocumentReader(self.options)

    def streamReader(self, schema: T.StructType) -> DocumentStreamReader:
        return DocumentStreamReader(self.options)


def read_documents(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Every document of a file, or of all files below a folder."""
    carried(__name__)
    spark.dataSource.register(DocumentSource)
    return spark.read.format("yaml_documents").option("rangeBytes", range_bytes).load(path)


def follow_documents(spark: SparkSession, path: str, log: str, range_bytes: int = 64 << 20) -> DataFrame:
    """The same as a stream of what comes into the folder; ``log`` is a folder that lives as long as the checkpoint."""
    carried(__name__)
    spark.dataSource.register(DocumentSource)
    return spark.readStream.format("yaml_documents").option("rangeBytes", range_bytes).option("log", log).load(path)
