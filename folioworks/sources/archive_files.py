"""Files of extracted archives as a Spark data source: files without a byte, ranges, and new files as a stream."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "archive_files"
SCHEMA = "archive_id string, path string, file string, length long, modified timestamp, content binary"
ARROW = pa.schema([
    ("archive_id", pa.string()), ("path", pa.string()), ("file", pa.string()), ("length", pa.int64()),
    ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary()),
])
#: Bytes and files that one task reads, a file at least.
SPLIT_BYTES, SPLIT_FILES = 64 << 20, 2000
#: Schemes that Arrow opens on executors; other stores are Spark's alone.
OPENED = ("", "file", "hdfs", "s3", "gs", "gcs")


def opened(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or address, and the place in it."""
    parts = urlparse(root)
    if parts.scheme in ("", "file"):
        return pa.fs.LocalFileSystem(), unquote(parts.path).rstrip("/") if parts.scheme else root.rstrip("/")
    system, place = pa.fs.FileSystem.from_uri(root)
    return system, place.rstrip("/")


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class _Listing:
    """What batch and stream share: the listing cut into tasks, and reading one of them."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.only_empty = options.get("only", "all") == "empty"

    def files(self, after: int = -1, until: int = 1 << 62) -> list[tuple[str, int, int]]:
        """(place, bytes, time of change in microseconds) of the files of archive folders changed in that span, by name."""
        system, place = opened(self.root)
        found = system.get_file_info(pa.fs.FileSelector(place, recursive=True, allow_not_found=True))
        rows = [(x.path, x.size, (x.mtime_ns or 0) // 1000) for x in found if x.type == pa.fs.FileType.File]
        inside = lambda p: "/" in p[len(place) + 1 :]
        return sorted(x for x in rows if inside(x[0]) and after < x[2] <= until and not (self.only_empty and x[1]))

    def tasks(self, files: list[tuple[str, int, int]]) -> list[Files]:
        out: list[list] = []
        held = 0
        for x in files:
            if not out or len(out[-1]) >= SPLIT_FILES or self.content and held + x[1] > SPLIT_BYTES:
                out.append([])
                held = 0
            out[-1].append(x)
            held += x[1]
        return [Files(x) for x in out]

    def batches(self, files: list[tuple[str, int, int]]) -> Iterator[pa.RecordBatch]:
        system, place = opened(self.root)
        rows, held = [], 0
        for file, size, modified in files:
            content = None
            if self.content:
                with system.open_input_file(file) as f:
                    content = f.read()
            archive, _, path = file[len(place) + 1 :].partition("/")
            rows.append((archive, f"/{path}", file, size, modified, content))
            held += size
            if held >= 8 << 20 or len(rows) >= 1000:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), ARROW)], schema=ARROW)


class ArchiveFiles(DataSource):
    """spark.read.format("archive_files").load(root): a folder under root is an archive, a file below it an entry.

    Options: content ("false": names and sizes only), only ("empty": files without a byte),
    settle (a stream's seconds before a changed file counts as whole, 0). Tasks are cut by bytes
    and files. A stream's offset is a time of change and the files of that time: it gives what
    changed since, empty files too, and goes on from its checkpoint. A file that comes with
    an older time than the last one's isn't noticed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "ArchiveReader":
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> "ArchiveStream":
        return ArchiveStream(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = _Listing(options)

    def partitions(self) -> list[Files]:
        return self.listing.tasks(self.listing.files()) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.batches(partition.files)


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.listing = _Listing(options)
        self.settle = float(options.get("settle", "0"))

    def initialOffset(self) -> dict:
        return {"until": -1, "at": []}

    def latestOffset(self) -> dict:
        """The latest change that is old enough, and the files of that very time, as others of it may follow."""
        found = self.listing.files(until=int((time.time() - self.settle) * 1e6))
        last = max((x[2] for x in found), default=-1)
        return {"until": last, "at": [x[0] for x in found if x[2] == last]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        found = self.listing.files(start["until"] - 1, end["until"])
        fresh = lambda x: (x[2] != start["until"] or x[0] not in start["at"]) and (x[2] != end["until"] or x[0] in end["at"])
        return self.listing.tasks([x for x in found if fresh(x)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.batches(partition.files)

    def commit(self, end: dict) -> None:
        pass


def archive_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveFiles)
    return spark.read.format(NAME).options(**options).load(root)


def stream_archive_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveFiles)
    return spark.readStream.format(NAME).options(**options).load(root)


def read_slices(wanted: DataFrame) -> DataFrame:
    """wanted(file, offset, length, ...) with ok and bytes: a range of each file, of which nothing else is read.

    Not ok, with null bytes, where the range is negative or passes the file's end; a null or missing
    file is not ok either. Rows of one file that follow each other share its opening."""
    names = wanted.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream, size = None, None, 0
        for batch in batches:
            ok, found = [], []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != at:
                    if stream is not None:
                        stream.close()
                    at, stream, size = file, None, -1
                    if file is not None:
                        system, place = opened(file)
                        try:
                            stream = system.open_input_file(place)
                            size = stream.size()
                        except FileNotFoundError:
                            pass
                good = None not in (file, offset, length) and offset >= 0 and length >= 0 and offset + length <= size
                ok.append(good)
                found.append(stream.read_at(length, offset) if good else None)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ok, pa.bool_()), pa.array(found, pa.binary())], [*names, "ok", "bytes"])
        if stream is not None:
            stream.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.sortWithinPartitions("file", "offset").mapInArrow(work, f"{fields}, ok boolean, bytes binary")


def empty_entries(spark: SparkSession, root: str) -> DataFrame:
    """(archive_id, path, length, content, modificationTime) of the files below root without a byte."""
    rows = archive_files(spark, root, only="empty", content="false")
    return rows.select("archive_id", "path", "length", F.lit(bytearray()).alias("content"), F.col("modified").alias("modificationTime"))
