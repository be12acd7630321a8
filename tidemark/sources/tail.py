"""A stream of the lines of one growing file, for logs that are appended to and now and then begun anew.

The offset is the byte behind the last whole line, so a restarted query goes
on from its checkpoint. A file that has become shorter than what was read was
truncated or replaced: reading starts over at its first byte. Each batch is
cut into byte ranges, which tasks read side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tidemark_tail"
RANGE_BYTES = 64_000_000
CHUNK = 1 << 20


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, name


def whole_lines(path: str) -> int:
    """Bytes up to the end of the file's last whole line; 0 while there is no file."""
    system, name = _opened(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        return 0
    with system.open_input_file(name) as f:
        end = info.size
        while end > 0:
            begin = max(0, end - CHUNK)
            f.seek(begin)
            if (at := f.read(end - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            end = begin
    return 0


def lines_in(path: str, first: int, last: int, begin: int) -> Iterator[tuple[int, str]]:
    """(byte, line) of the lines that start in [first, last); ``begin`` is where the first line of all ranges starts."""
    system, name = _opened(path)
    with system.open_input_file(name) as f:
        # A range in the middle leaves out the line that the one before has begun.
        at = first if first == begin else first - 1
        f.seek(at)
        rest, skip = b"", first != begin
        while at < last:
            data = f.read(CHUNK)
            if not data and not rest:
                return
            parts = (rest + data).split(b"\n")
            rest = parts.pop() if data else b""
            for line in parts:
                if skip:
                    skip = False
                elif at < last:
                    yield at, line.decode("utf-8", "replace").removesuffix("\r")
                else:
                    return
                at += len(line) + 1
            if not data:
                return


class _Range(InputPartition):
    def __init__(self, first: int, last: int, begin: int):
        self.first, self.last, self.begin = first, last, begin


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self, *_) -> dict:
        return {"position": whole_lines(self.path)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        first, last = start["position"], end["position"]
        if last < first:
            first = 0
        return [_Range(at, min(at + self.size, last), first) for at in range(first, last, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple[int, str]]:
        return lines_in(self.path, partition.first, partition.last, partition.begin)


class TailSource(DataSource):
    """``spark.readStream.format("tidemark_tail").option("path", ...)``: (position, value), one row for each line."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "position long, value string"

    def streamReader(self, schema) -> _TailReader:
        return _TailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of one file as a stream; ``path`` is local or a URI that Arrow opens, the same on all executors."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).option("rangeBytes", range_bytes).load(path)
