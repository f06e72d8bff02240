"""Growing log files as a stream whose offsets are byte positions.

An offset maps each file to the position behind its last complete line, so a line that is still being written waits
for its end, a restarted query goes on where it stopped, and every line is known by (file, position).  Files are
found and read by ranges with ``pyarrow.fs``, which takes local paths, mounted folders and the URIs of its stores.

A file that became shorter was replaced and is read from its start.  Files whose names start with ``_`` or ``.``
are not logs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "shelf_log_tail"
SCHEMA = "file string, position long, value string"
#: Bytes of one task, and bytes read at once.
RANGE_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that start in ``[start, end)``; all of them end before ``stop``."""

    file: str
    start: int
    end: int
    stop: int


def lines_between(source, start: int, end: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Position and bytes of the lines that start in ``[start, end)`` of an open file."""
    at = start
    if start:  # a line that starts before belongs to the range before
        source.seek(start - 1)
        at = start - 1
    held = b""
    skip = start > 0
    while at < stop:
        chunk = source.read(min(CHUNK_BYTES, stop - at - len(held)))
        if not chunk:
            return
        *full, held = (held + chunk).split(b"\n")
        for line in full:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, line
            at += len(line) + 1
        if at >= end and not skip:
            return


def last_line_end(source, known: int, size: int) -> int:
    """Position behind the last line end in ``[known, size)``, or ``known``."""
    end = size
    while end > known:
        start = max(known, end - CHUNK_BYTES)
        source.seek(start)
        found = source.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return known


class LogTailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes
        self.ends: dict[str, int] = {}

    def _files(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return store, [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        store, files = self._files()
        for f in files:
            known = self.ends.get(f.path, 0)
            if f.size < known:
                known = 0
            if f.size > known:
                with store.open_input_file(f.path) as source:
                    known = last_line_end(source, known, f.size)
            self.ends[f.path] = known
        return {"files": json.dumps(self.ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.ends = {**after, **self.ends}
        out = []
        for file, stop in sorted(after.items()):
            first = before.get(file, 0)
            if stop < first:
                first = 0
            out += [Range(file, a, min(a + self.range_bytes, stop), stop) for a in range(first, stop, self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            positions, lines = zip(*rows)
            values = [line.decode("utf-8", "replace") for line in lines]
            return pa.RecordBatch.from_pydict({"file": pa.array([partition.file] * len(rows), pa.string()),
                                               "position": pa.array(positions, pa.int64()), "value": pa.array(values, pa.string())})

        with store.open_input_file(partition.file) as source:
            for row in lines_between(source, partition.start, partition.end, partition.stop):
                rows.append(row)
                size += len(row[1])
                if size >= CHUNK_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def tail_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``[file, position, value]`` of complete lines as they are appended below ``path``, a stream."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format(FORMAT).option("rangebytes", range_bytes).load(path)
