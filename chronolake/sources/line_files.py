"""Files of lines as data sources of Spark's Python interface.

``line_files`` reads the lines of files with where they stand, splits files
into ranges of bytes, follows files that grow as a stream whose offsets are the
bytes read, and writes JSON lines. ``event_csv`` reads event logs whose
delimiter, header and columns are found in each file. Files are reached through
Arrow's file systems (local, HDFS, object stores).

A range has the lines that begin in it: its reader goes to the byte before,
passes the line that reaches into it, and reads its last line to the end. A
line is a row, so a quoted field does not hold a line end.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .logs import find_column

RANGE = 32 << 20
#: What is looked at for the delimiter and the header, and the delimiters there are (fixed values of the rule).
SAMPLE, DELIMITERS = 8192, ",\t;"
LINE = "file string, at long, value string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder whose names don't begin with a dot or an underscore."""
    fs, p = _opened(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        return []
    head = path.split("://")[0] + "://" if "://" in path else ""
    rest = [f for f in fs.get_file_info(pafs.FileSelector(p, recursive=True)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
    authority = path[len(head) :][: -len(p)] if head and path[len(head) :].endswith(p) else ""
    return sorted((f"{head}{authority}{f.path}", f.size) for f in rest)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    extra: tuple = ()

    def __init__(self, file: str, start: int, end: int, extra: tuple = ()):
        self.file, self.start, self.end, self.extra = file, start, end, extra


def ranges(file: str, start: int, end: int, size: int, extra: tuple = ()) -> list[Range]:
    return [Range(file, a, min(a + size, end), extra) for a in range(start, end, size)]


def lines(r: Range, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that begin in the range; ``first`` is where a line is known to begin."""
    fs, p = _opened(r.file)
    with io.BufferedReader(fs.open_input_file(p), 1 << 20) as raw:
        at = r.start
        if at > first:
            raw.seek(at - 1)
            at += len(raw.readline()) - 1
        else:
            raw.seek(at)
        while at < r.end:
            line = raw.readline()
            if not line:
                return
            yield at, line.rstrip(b"\r\n")
            at += len(line)


def _whole(file: str, start: int, size: int, chunk: int = 1 << 16) -> int:
    """The place after the last line end of a file, at or after ``start``."""
    fs, p = _opened(file)
    with fs.open_input_file(p) as raw:
        end = size
        while end > start:
            at = max(start, end - chunk)
            raw.seek(at)
            k = raw.read(end - at).rfind(b"\n")
            if k >= 0:
                return at + k + 1
            end = at
    return start


class LineFiles(DataSource):
    """``spark.read.format("line_files").load(path)``: (file, at, value); option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return LINE

    def _size(self) -> int:
        return int(self.options.get("rangeBytes", RANGE))

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"], self._size())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineStream(self.options["path"], self._size())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _LineWriter(self.options["path"], [f.name for f in schema.fields], overwrite)


class _LineReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        return [r for file, n in listed(self.path) for r in ranges(file, 0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, line in lines(partition) if partition.file else ():
            yield partition.file, at, line.decode("utf-8", "replace")


class _LineStream(DataSourceStreamReader):
    """Offsets are the bytes read of each file. A line is taken once its end is there."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.seen = {file: _whole(file, self.seen.get(file, 0), n) for file, n in listed(self.path)}
        return {f: n for f, n in self.seen.items() if n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # The batch before ended at a line end, so a line begins at its offset.
        return [Range(r.file, r.start, r.end, (start.get(file, 0),)) for file, n in sorted(end.items()) for r in ranges(file, start.get(file, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, line in lines(partition, partition.extra[0]):
            yield partition.file, at, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    made: str
    final: str


class _LineWriter(DataSourceWriter):
    """A file a task, under a hidden name until the job commits; an aborted one leaves nothing."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path.rstrip("/"), names, overwrite, uuid.uuid4().hex

    def write(self, rows) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{self.run}.jsonl"
        made, final = f"{self.path}/.{context.taskAttemptId()}-{name}", f"{self.path}/{name}"
        fs, p = _opened(made)
        fs.create_dir(_opened(self.path)[1], recursive=True)
        with fs.open_output_stream(p) as out:
            for row in rows:
                value = row.asDict(recursive=True)
                out.write((json.dumps({n: value[n] for n in self.names}, ensure_ascii=True, sort_keys=True, default=str) + "\n").encode())
        return _Written(made, final)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        before = [f for f, _ in listed(self.path)] if self.overwrite else []
        for m in done:
            fs, p = _opened(m.made)
            fs.move(p, _opened(m.final)[1])
        for f in before:
            fs, p = _opened(f)
            fs.delete_file(p)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                fs, p = _opened(m.made)
                fs.delete_file(p)


class EventCsv(DataSource):
    """Event logs with known columns, all as text.

    ``columns``: JSON of {name: [aliases]}. Each file's delimiter and header
    are found in its first bytes: the header is the first row that is not
    blank. A column that a file hasn't is null; so is a cell that a row hasn't.
    """

    @classmethod
    def name(cls) -> str:
        return "event_csv"

    def _wanted(self) -> dict[str, list[str]]:
        return json.loads(self.options["columns"])

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in self._wanted())

    def reader(self, schema) -> DataSourceReader:
        return _CsvReader(self.options["path"], self._wanted(), int(self.options.get("rangeBytes", RANGE)))


def sniffed(sample: bytes) -> tuple[str, list[str], int]:
    """(delimiter, header, where its line ends) of a file's first bytes; no header: an empty one."""
    text = sample.decode("utf-8-sig", "replace")
    try:
        delimiter = csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter
    except csv.Error:
        delimiter = ","
    at = 0
    for line in sample.splitlines(keepends=True):
        at += len(line)
        row = next(csv.reader([line.decode("utf-8-sig", "replace").rstrip("\r\n")], delimiter=delimiter), [])
        if any(cell.strip() for cell in row):
            return delimiter, row, at
    return delimiter, [], at


class _CsvReader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, list[str]], size: int):
        self.path, self.wanted, self.size = path, wanted, size

    def partitions(self) -> list[Range]:
        out = []
        for file, n in listed(self.path):
            fs, p = _opened(file)
            with fs.open_input_file(p) as raw:
                delimiter, header, body = sniffed(raw.read(SAMPLE))
            if not header:
                continue
            found = {name: find_column(header, [name, *aliases]) for name, aliases in self.wanted.items()}
            places = tuple(header.index(c) if c is not None else None for c in found.values())
            out += [Range(r.file, r.start, r.end, (body, delimiter, places)) for r in ranges(file, body, n, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.file:
            return
        body, delimiter, places = partition.extra
        for _, line in lines(partition, body):
            row = next(csv.reader([line.decode("utf-8", "replace")], delimiter=delimiter), [])
            if row:
                yield tuple(row[k] if k is not None and k < len(row) else None for k in places)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineFiles)
    spark.dataSource.register(EventCsv)


def read_jsonl(spark: SparkSession, path: str, schema: str, stream: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """JSON objects, one a line, by a schema; blank lines are passed over, and a line that is no object gives nulls."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format("line_files").option("rangeBytes", range_bytes)
    rows = reader.load(path).filter(F.trim("value") != "")
    return rows.select(F.from_json("value", schema).alias("o")).select("o.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Add the rows as lines of JSON, keys sorted and other characters than ASCII escaped, or none of them."""
    register(df.sparkSession)
    df.write.format("line_files").mode("append").save(path)


def read_event_csv(spark: SparkSession, path: str, wanted: dict[str, list[str]], range_bytes: int = RANGE) -> DataFrame:
    register(spark)
    return spark.read.format("event_csv").option("columns", json.dumps(wanted)).option("rangeBytes", range_bytes).load(path)
