"""Message logs: topics kept as segments in a shared folder, with an offset for every message of a partition.

A topic is ``<path>/partition=<p>/<first offset>-<messages>.parquet``. It is written by ``format("message_log")`` (rows
``key, value``; a key always goes to the same partition) and read back by it as ``partition, offset, value``, in
batches or as a stream that starts again where its checkpoint says. Files are reached through ``pyarrow.fs``, so a
path may be a local, HDFS or object-store address. One writer at a time.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

NAME = "message_log"
SCHEMA = "partition int, offset long, value string"
_SEGMENT = re.compile(r"partition=(\d+)/(\d+)-(\d+)\.parquet$")
_OUT = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("value", pa.string())])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def segments(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, messages, file) of each partition's segments, in order."""
    store, root = file_system(path)
    found = defaultdict(list)
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        if match := _SEGMENT.search(info.path):
            partition, first, count = map(int, match.groups())
            found[partition].append((first, count, info.path))
    return {p: sorted(s) for p, s in sorted(found.items())}


def end_offsets(path: str) -> dict[int, int]:
    """The offset after the last message of each partition."""
    return {p: s[-1][0] + s[-1][1] for p, s in segments(path).items()}


def first_offsets(path: str) -> dict[int, int]:
    return {p: s[0][0] for p, s in segments(path).items()}


class LostMessages(Exception):
    """Offsets that were asked for are no longer in the log."""


@dataclass
class Stretch(InputPartition):
    """Messages ``first`` up to ``end`` of a segment that begins at ``begin``."""

    partition: int
    begin: int
    first: int
    end: int
    file: str


def stretches(path: str, start: dict[int, int], end: dict[int, int], fail: bool) -> list[Stretch]:
    """What to read between two sets of offsets. Missing segments fail, or are passed over."""
    found = []
    held = segments(path)
    for partition, upto in sorted(end.items()):
        at = start.get(partition, 0)
        for first, count, file in held.get(partition, []):
            if first >= upto or first + count <= at:
                continue
            if first > at and fail:
                raise LostMessages(f"partition {partition}: offsets {at} to {first} are gone")
            found.append(Stretch(partition, first, max(first, at), min(first + count, upto), file))
            at = min(first + count, upto)
        if at < upto and fail:
            raise LostMessages(f"partition {partition}: offsets {at} to {upto} are gone")
    return found


def read_stretch(path: str, part: Stretch) -> Iterator[pa.RecordBatch]:
    store, _ = file_system(path)
    at = part.begin
    with store.open_input_file(part.file) as source:
        for batch in pq.ParquetFile(source).iter_batches(columns=["value"]):
            low, high = max(part.first, at), min(part.end, at + len(batch))
            if low < high:
                values = batch.column(0).slice(low - at, high - low)
                offsets = pa.array(range(low, high), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part.partition] * len(values), pa.int32()), offsets, values], schema=_OUT)
            at += len(batch)


def _offsets(text: str, path: str) -> dict[int, int]:
    """Offsets as an option has them: earliest, latest, or a JSON object."""
    if text == "earliest":
        return first_offsets(path)
    if text == "latest":
        return end_offsets(path)
    return {**first_offsets(path), **{int(p): int(o) for p, o in json.loads(text).items()}}


class BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fail = options["path"], options.get("failondataloss", "true") == "true"
        self.start, self.end = options.get("startingoffsets", "earliest"), options.get("endingoffsets", "latest")

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, _offsets(self.start, self.path), _offsets(self.end, self.path), self.fail)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from read_stretch(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Options: ``startingOffsets`` (of a first start; earliest, latest or JSON), ``failOnDataLoss``, ``maxOffsetsPerTrigger`` (of each
    partition), and ``progress``, a folder where the end of each planned batch is noted, so that the limit also holds after a restart."""

    def __init__(self, options: dict):
        self.path, self.fail = options["path"], options.get("failondataloss", "true") == "true"
        self.start, self.begin = options.get("startingoffsets", "latest"), None
        self.limit = int(options["maxoffsetspertrigger"]) if "maxoffsetspertrigger" in options else None
        self.progress = options.get("progress")
        if self.limit is not None and not self.progress:
            raise ValueError("maxOffsetsPerTrigger needs a folder for progress")
        # Where the stream stands; Spark asks for the latest offsets before it tells where a stream begins.
        self.at: dict[int, int] | None = self._noted()

    def _noted(self) -> dict[int, int] | None:
        if not self.progress:
            return None
        store, root = file_system(self.progress)
        file = posixpath.join(root, "end.json")
        if store.get_file_info(file).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(file) as source:
            return {int(p): o for p, o in json.loads(source.read()).items()}

    def _note(self, end: dict) -> None:
        self.at = {int(p): o for p, o in end.items()}
        if self.progress:
            store, root = file_system(self.progress)
            store.create_dir(root, recursive=True)
            with store.open_output_stream(posixpath.join(root, "next.json")) as out:
                out.write(json.dumps(end).encode())
            store.move(posixpath.join(root, "next.json"), posixpath.join(root, "end.json"))

    def initialOffset(self) -> dict:
        if self.begin is None:
            self.begin = _offsets(self.start, self.path)
        return {str(p): o for p, o in self.begin.items()}

    def latestOffset(self) -> dict:
        if self.limit is not None and self.at is None:
            self.initialOffset()
            self.at = self.begin
        ends, known = end_offsets(self.path), self.at or {}
        if self.limit is not None:
            ends = {p: min(o, known.get(p, 0) + self.limit) for p, o in ends.items()}
        return {str(p): max(ends.get(p, 0), known.get(p, 0)) for p in sorted({*ends, *known})}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self._note(end)
        return stretches(self.path, {int(p): o for p, o in start.items()}, {int(p): o for p, o in end.items()}, self.fail)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from read_stretch(self.path, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


@dataclass
class Staged(WriterCommitMessage):
    """Segments a task has written: (partition, messages, file)."""

    files: list[tuple[int, int, str]]


class Writer(DataSourceArrowWriter):
    """Tasks write segments aside; the driver then gives them their offsets by moving them into place."""

    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options.get("partitions", "1"))
        self.aside = f"_staged/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, root = file_system(self.path)
        folder = posixpath.join(root, self.aside)
        store.create_dir(folder, recursive=True)
        open_files, name = {}, uuid.uuid4().hex
        for batch in iterator:
            parts = batch.column("partition")
            for p in parts.unique().to_pylist():
                rows = batch.filter(pa.compute.equal(parts, p)).select(["value"])
                if p not in open_files:
                    file = posixpath.join(folder, f"{p}-{name}.parquet")
                    open_files[p] = [pq.ParquetWriter(file, rows.schema, filesystem=store), 0, file]
                open_files[p][0].write_batch(rows)
                open_files[p][1] += len(rows)
        for out, _, _ in open_files.values():
            out.close()
        return Staged([(p, n, file) for p, (_, n, file) in sorted(open_files.items())])

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = file_system(self.path)
        ends = end_offsets(self.path)
        for p, count, file in sorted(f for m in messages if m for f in m.files):
            folder = posixpath.join(root, f"partition={p}")
            store.create_dir(folder, recursive=True)
            store.move(file, posixpath.join(folder, f"{ends.get(p, 0):020d}-{count}.parquet"))
            ends[p] = ends.get(p, 0) + count

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = file_system(self.path)
        folder = posixpath.join(root, self.aside)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _plain(self) -> dict:
        return {name.lower(): value for name, value in dict(self.options).items()}

    def reader(self, schema) -> BatchReader:
        return BatchReader(self._plain())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._plain())

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a log is appended to")
        return Writer(self._plain())


def append(
    rows: DataFrame, path: str, partitions: int, key: str = "key", value: str = "value", place: Column | None = None
) -> None:
    """Add messages to a topic of so many partitions; messages of a key keep their partition, those without one share the first.

    ``place`` (0 up to the number of partitions) says where a message goes instead of its key.
    """
    rows.sparkSession.dataSource.register(MessageLog)
    by_key = F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(partitions)))
    placed = (by_key if place is None else place).cast("int")
    rows.select(placed.alias("partition"), F.col(value).cast("string").alias("value")).write.format(NAME).mode("append").option(
        "partitions", partitions
    ).save(path)


def read_log(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MessageLog)
    return spark.read.format(NAME).options(path=path, **options).load()


def read_log_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Messages as they are added."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format(NAME).options(path=path, **options).load()
