"""Logs of JSON lines in zstd files, as a data source: `spark.read.format("zstd_log")` and `df.write.format("zstd_log")`.

Spark's own JSON reader inflates zstd only where Hadoop's native codec is installed. Here a file is a partition: it is
inflated in stretches, each stretch is parsed by columns, and rows that fail a pushed filter are dropped before they
reach the JVM, so a task holds a stretch and never a file. Files are opened by pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of inflated lines that are parsed at once.
STRETCH = 8 << 20
#: Keys that are pushed to the source as a list; more are joined by Spark alone.
MOST_KEYS = 10_000

_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


@dataclass
class LogFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    name: str | None


def stretches(stream: io.RawIOBase, size: int) -> Iterator[bytes]:
    """Bytes of whole lines, so many at once; a longer line comes alone."""
    rest = b""
    while piece := stream.read(size):
        cut = piece.rfind(b"\n") + 1
        if cut:
            yield rest + piece[:cut]
            rest = piece[cut:]
        else:
            rest += piece
    if rest.strip():
        yield rest


def _fits(value, kind: pa.DataType):
    """The value as the column's type, or None where JSON holds another kind."""
    try:
        if pa.types.is_string(kind) and not isinstance(value, str):
            return None
        if (pa.types.is_integer(kind) or pa.types.is_floating(kind)) and (isinstance(value, bool) or not isinstance(value, int | float)):
            return None
        return pa.scalar(int(value) if pa.types.is_integer(kind) else value, kind).as_py()
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        return None


def parse(lines: bytes, schema: pa.Schema) -> pa.Table:
    """The columns of schema out of JSON lines; other fields are not kept.

    Where a line is broken or a field has another type, the stretch is parsed line by line: broken lines and lines that
    are no objects go, and fields of another type are null.
    """
    options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
    try:
        return pj.read_json(io.BytesIO(lines), pj.ReadOptions(use_threads=False, block_size=max(len(lines), 1 << 16)), options).select(schema.names).cast(schema)
    except (pa.ArrowException, KeyError):
        rows = []
        for line in lines.split(b"\n"):
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                rows.append({f.name: _fits(row.get(f.name), f.type) for f in schema})
        return pa.Table.from_pylist(rows, schema)


class LogReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, stretch: int):
        self.schema, self.path, self.stretch, self.filters = schema, path, stretch, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps comparisons of plain columns with values; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (*_COMPARE, In, IsNotNull)) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[LogFile]:
        store, path = open_fs(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name.endswith((".zst", ".zstd"))]
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(path) :].split("/"))
        head = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        # the largest first, so that no long one starts last
        return [LogFile(head + f.path) for f in sorted(files, key=lambda f: (-(f.size or 0), f.path)) if not hidden(f.path)]

    def _keeps(self, table: pa.Table) -> pa.Table:
        for f in self.filters:
            column = table.column(f.attribute[0])
            if isinstance(f, IsNotNull):
                mask = pc.is_valid(column)
            elif isinstance(f, In):
                mask = pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type))
            else:
                mask = _COMPARE[type(f)](column, pa.scalar(f.value, column.type))
            table = table.filter(mask)
        return table

    def read(self, partition: LogFile) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        store, path = open_fs(partition.path)
        with store.open_input_stream(path, compression=None) as raw, zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
            for lines in stretches(stream, self.stretch):
                yield from self._keeps(parse(lines, arrow)).combine_chunks().to_batches(65536)


class LogWriter(DataSourceArrowWriter):
    """A task writes one file under _staging; the commit moves those of the tasks that won, so no reader sees half a log."""

    def __init__(self, path: str, overwrite: bool, level: int):
        self.path, self.overwrite, self.level, self.job = path.rstrip("/"), overwrite, level, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"part-{uuid.uuid4().hex}.jsonl.zst"
        store, path = open_fs(f"{self.path}/_staging/{self.job}")
        store.create_dir(path, recursive=True)
        rows = 0
        with store.open_output_stream(f"{path}/{name}", compression=None) as raw, zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False) as out:
            for batch in iterator:
                rows += batch.num_rows
                for row in batch.to_pylist():
                    out.write(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, default=str).encode() + b"\n")
        return Written(name if rows else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = open_fs(self.path)
        names = [m.name for m in messages if m is not None and m.name]
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file:
                    store.delete_file(f.path)
        for name in names:
            store.move(f"{path}/_staging/{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, path = open_fs(f"{self.path}/_staging/{self.job}")
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_dir(path)


class ZstdLog(DataSource):
    """Options: path, stretch (bytes parsed at once), level (of compression). A read needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "zstd_log"

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options["path"], int(self.options.get("stretch", STRETCH)))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite, int(self.options.get("level", 3)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZstdLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_event_log(rows: DataFrame, path: str, level: int = 3) -> None:
    """rows as JSON lines in zstd files, one a task; a null field is left out."""
    register(rows.sparkSession)
    rows.write.format("zstd_log").option("level", level).mode("append").save(path)


def read_event_log(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str = "entity", at: str | None = None, since=None, until=None) -> DataFrame:
    """Lines of the zstd logs under path whose key is among keys, in [since, until] of the column `at` where these are given.

    Times are dropped while a file is read; so are other keys, if there are at most MOST_KEYS. More keys are joined:
    Spark broadcasts them by their size, and beyond its bound both sides are shuffled. Null keys match nothing.
    """
    register(spark)
    rows = spark.read.format("zstd_log").schema(schema).load(path)
    if since is not None:
        rows = rows.where(F.col(at) >= since)
    if until is not None:
        rows = rows.where(F.col(at) <= until)
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in wanted.limit(MOST_KEYS + 1).collect()]
    if len(few) <= MOST_KEYS:
        return rows.where(F.col(key).isin(few)) if few else rows.where("false")
    return rows.join(wanted, key, "left_semi")
