"""Log files as a Spark data source, and CSV with a byte order mark as a sink.

``spark.read.format("fieldlog").load(path)`` gives a row for each line of the text files under a folder: ``file, at`` (its first byte), ``kind``
(what stands before the first comma), ``seconds`` (of the day, of sentences whose second field is a clock time) and ``value`` (the line).
Files are cut into byte ranges, a task each. Filters on ``kind`` and ``seconds`` reach the reader where the session allows it
(``spark.sql.python.filterPushdown.enabled``, see ``read_logs``), and the option ``kinds`` does always; other lines never leave Python.

``df.write.format("marked_csv").mode("append").save(path)`` writes parts whose first three bytes are the mark that spreadsheet programs look
for. Parts appear under their names only when all tasks have ended; a failed write leaves none.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import Row, StructType

#: Bytes of a task's range.
RANGE_BYTES = 64 << 20
#: Bytes read, and rows handed on, at once.
READ_BYTES, BATCH_ROWS = 1 << 20, 8192
SCHEMA = "file string, at long, kind string, seconds double, value string"
MARK = b"\xef\xbb\xbf"
_PUSHED = {ds.EqualTo: lambda x, v: x == v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v, ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v, ds.In: lambda x, v: x in v, ds.StringStartsWith: lambda x, v: x.startswith(v), ds.IsNotNull: lambda x, v: True}


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(LogSource)
    spark.dataSource.register(MarkedCsv)


def read_logs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of the log files under ``path``; filters are pushed to the reader if the session allows it."""
    return spark.read.format("fieldlog").options(pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled"), **options).load(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared folder (spark.checkpoint.dir); a local session without one takes the warehouse's."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/fieldtrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"/{path}")


def clock_seconds(field: str) -> float | None:
    """Seconds of the day of hhmmss.fff; anything else: None."""
    try:
        if not field[:6].isdigit() or len(field) < 6 or len(field) > 6 and field[6] != ".":
            return None
        return int(field[:2]) * 3600 + int(field[2:4]) * 60 + float(field[4:])
    except ValueError:
        return None


@dataclass
class Range(ds.InputPartition):
    """Bytes of a file; the lines that begin in them are this task's."""

    file: str
    start: int
    end: int


class LogSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "fieldlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LogReader:
        wanted = {x.split()[0]: x.split()[1] for x in SCHEMA.split(", ")}
        for f in schema:
            if wanted.get(f.name) != f.dataType.simpleString().replace("bigint", "long"):
                raise ValueError(f"a log has the columns {SCHEMA}, not {f.name} {f.dataType.simpleString()}")
        return (PushingLogReader if self.options.get("pushdown") == "true" else LogReader)(dict(self.options))


class LogReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.suffixes = tuple(options.get("suffixes", ".ascii,.txt,.log").split(","))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        kinds = options.get("kinds")
        self.tests: list[tuple[str, type, object]] = [("kind", ds.In, tuple(kinds.split(",")))] if kinds else []

    def partitions(self) -> list[Range]:
        fs, folder = open_folder(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and f.path.endswith(self.suffixes))
        return [Range(p, s, min(s + self.range_bytes, n)) for p, n in files for s in range(0, n, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        fs, _ = open_folder(self.path)
        rows: list[tuple] = []
        with fs.open_input_file(partition.file) as f:
            for at, raw in lines_of(f, partition.start, partition.end):
                value = raw.decode("utf-8", "replace")
                parts = value.split(",", 2)
                row = (partition.file, at, parts[0], clock_seconds(parts[1]) if len(parts) > 1 else None, value)
                if all((x := row[2] if name == "kind" else row[3]) is not None and _PUSHED[test](x, v) for name, test, v in self.tests):
                    rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


class PushingLogReader(LogReader):
    """The reader for sessions that push filters; Spark refuses it in others."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _PUSHED and f.attribute in (("kind",), ("seconds",)):
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f


def lines_of(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """First byte and content of the lines that begin in start..end - 1; the last one may end behind them."""
    at = max(0, start - 1)  # with the byte before, so that a line that begins at ``start`` is known to
    f.seek(at)
    rest, skip = b"", start > 0
    while at < end:
        piece = f.read(READ_BYTES)
        rest += piece
        lines = rest.split(b"\n")
        rest = lines.pop() if piece else b""
        if not piece:
            lines = [x for x in lines if x] if lines else lines
        for line in lines:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, line.removesuffix(b"\r")
            at += len(line) + 1
        if not piece:
            return


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    names = [x.split() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


class MarkedCsv(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "marked_csv"

    def writer(self, schema: StructType, overwrite: bool) -> MarkedCsvWriter:
        return MarkedCsvWriter(self.options["path"], schema.names, overwrite)


@dataclass
class Part(ds.WriterCommitMessage):
    hidden: str
    name: str
    rows: int


class MarkedCsvWriter(ds.DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite, self.run = path, names, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Part:
        fs, folder = open_folder(self.path)
        task = TaskContext.get()
        part = Part(f"{folder}/_{self.run}/{task.partitionId()}-{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}-{self.run}.csv", 0)
        fs.create_dir(f"{folder}/_{self.run}")
        with fs.open_output_stream(part.hidden) as out:
            text = io.StringIO(newline="")
            lines = csv.writer(text, lineterminator="\n")
            lines.writerow(self.names)
            out.write(MARK)
            for row in rows:
                lines.writerow(["" if v is None else v for v in row])
                part.rows += 1
                if text.tell() > READ_BYTES:
                    out.write(text.getvalue().encode())
                    text.seek(0)
                    text.truncate()
            out.write(text.getvalue().encode())
        return part

    def commit(self, messages: list[Part | None]) -> None:
        fs, folder = open_folder(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file] if self.overwrite else []
        for m in messages:
            if m is not None and (m.rows or m is messages[0]):
                fs.move(m.hidden, m.name)
        for p in old:
            fs.delete_file(p)
        fs.delete_dir(f"{folder}/_{self.run}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = open_folder(self.path)
        if fs.get_file_info(f"{folder}/_{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{folder}/_{self.run}")
