"""The log as a Spark data source: partitions of gapless offsets, kept in immutable segments and appended by numbered commits.

A folder holds ``data/`` (Parquet segments of key and value) and ``_commits/``
(numbered JSON files). A commit names its segments with their partition, first
offset and number of rows, and the next offset of every partition before and
after it. Offsets are given when a commit is made: a row's is the first of its
segment plus its place there, so tasks need not know of one another.

Folders are reached through ``pyarrow.fs``: local paths and the addresses of the
stores that it knows.
"""

from __future__ import annotations

import json
import logging
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from wattline.functions.cluster import ship

log = logging.getLogger(__name__)
FORMAT = "wattline_log"
SCHEMA = "key string, partition int, offset bigint, value binary"
ARROW = pa.schema([("key", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("value", pa.binary())])
STORED = pa.schema([("key", pa.string()), ("value", pa.binary())])
SEGMENT_BYTES = 64 << 20
READ_ROWS = 1 << 18


class LostOffsets(RuntimeError):
    """Records that a reader has not seen yet are gone."""


@dataclass
class Segment:
    """A file of rows of one partition; ``first`` is known once it is committed."""

    partition: int
    count: int
    file: str
    first: int = -1


@dataclass
class Commit:
    number: int = 0
    segments: list[Segment] = field(default_factory=list)
    #: Next offset of each partition, by its number as text, before and after this commit.
    start: dict[str, int] = field(default_factory=dict)
    next: dict[str, int] = field(default_factory=dict)
    #: Records of the log up to here, and the last batch of each named writer.
    records: int = 0
    writers: dict[str, int] = field(default_factory=dict)

    def position(self) -> dict:
        return {"commit": self.number, "records": self.records, "next": self.next}


class LogFolder:
    """Commits and segments of one log. One writer at a time."""

    def __init__(self, path: str):
        self.fs, self.top = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
        self.top = self.top.rstrip("/")

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.top}/_commits", allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def _file(self, number: int) -> str:
        return f"{self.top}/_commits/{number:012d}.json"

    def has(self, number: int) -> bool:
        return self.fs.get_file_info(self._file(number)).type == fs.FileType.File

    def commit(self, number: int) -> Commit:
        with self.fs.open_input_stream(self._file(number)) as file:
            found = json.loads(file.read())
        return Commit(**found | {"segments": [Segment(**x) for x in found["segments"]]})

    def last(self) -> Commit:
        found = self.numbers()
        return self.commit(found[-1]) if found else Commit()

    def earliest(self) -> dict:
        """The position before the first record that is still there."""
        found = self.numbers()
        if not found:
            return Commit().position()
        first = self.commit(found[0])
        return Commit(number=first.number - 1, next=first.start, records=first.records - sum(x.count for x in first.segments)).position()

    def put(self, path: str, text: str) -> None:
        """A whole file or none."""
        draft = f"{self.top}/_commits/{uuid.uuid4().hex}.draft"
        self.fs.create_dir(f"{self.top}/_commits", recursive=True)
        with self.fs.open_output_stream(draft) as file:
            file.write(text.encode())
        self.fs.move(draft, path)

    def stage(self, batches: Iterator[pa.RecordBatch], most_bytes: int = SEGMENT_BYTES) -> list[Segment]:
        """Rows (key, value and, if there is one, partition) as segments that no commit names yet, in their order."""
        self.fs.create_dir(f"{self.top}/data", recursive=True)
        done: list[Segment] = []
        open_: dict[int, tuple[Segment, pq.ParquetWriter, list[int]]] = {}

        def close(partition: int) -> None:
            open_.pop(partition)[1].close()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers = table["partition"].combine_chunks() if "partition" in table.column_names else pa.array([0] * len(table), pa.int32())
            for partition in pc.unique(numbers).to_pylist():
                rows = table.filter(pc.equal(numbers, partition)).select(["key", "value"]).cast(STORED)
                if partition not in open_:
                    segment = Segment(partition, 0, f"{uuid.uuid4().hex}.parquet")
                    done.append(segment)
                    open_[partition] = segment, pq.ParquetWriter(f"{self.top}/data/{segment.file}", STORED, compression="zstd", filesystem=self.fs), [0]
                segment, writer, size = open_[partition]
                writer.write_table(rows)
                segment.count += len(rows)
                size[0] += rows.nbytes
                if size[0] >= most_bytes:
                    close(partition)
        for partition in list(open_):
            close(partition)
        return done

    def discard(self, staged: Sequence[Segment]) -> None:
        for segment in staged:
            try:
                self.fs.delete_file(f"{self.top}/data/{segment.file}")
            except OSError as error:
                log.warning("staged segment %s stays: %s", segment.file, error)

    def append(self, staged: Sequence[Segment], writer: str | None = None, batch: int | None = None) -> Commit | None:
        """Give staged segments their offsets and make them part of the log; a batch that its writer has committed before changes nothing."""
        last = self.last()
        if writer is not None and batch is not None and last.writers.get(writer, -1) >= batch:
            self.discard(staged)
            return None
        if not staged and writer is None:
            return None
        following = dict(last.next)
        for segment in staged:
            segment.first = following.get(str(segment.partition), 0)
            following[str(segment.partition)] = segment.first + segment.count
        writers = last.writers | ({writer: batch} if writer is not None and batch is not None else {})
        made = Commit(last.number + 1, list(staged), last.next, following, last.records + sum(x.count for x in staged), writers)
        if self.has(made.number):
            raise RuntimeError(f"{self.top} has another writer")
        self.put(self._file(made.number), json.dumps(made, default=vars))
        return made

    def between(self, start: dict, end: dict, fail: bool = True) -> list[Segment]:
        """The segments after position ``start`` up to ``end``, without a gap in any partition."""
        found: list[Segment] = []
        at = dict(start["next"])
        for number in range(start["commit"] + 1, end["commit"] + 1):
            if not self.has(number):
                if fail:
                    raise LostOffsets(f"commit {number} of {self.top} is gone")
                log.warning("commit %d of %s is skipped: it is gone", number, self.top)
                continue
            for segment in self.commit(number).segments:
                wanted = at.get(str(segment.partition), 0)
                if segment.first != wanted and fail:
                    raise LostOffsets(f"offsets {wanted} to {segment.first - 1} of partition {segment.partition} of {self.top} are gone")
                at[str(segment.partition)] = segment.first + segment.count
                found.append(segment)
        return found

    def rows(self, segment: Segment, fail: bool = True) -> Iterator[pa.RecordBatch]:
        """A segment's rows with their partition and offsets."""
        try:
            source = self.fs.open_input_file(f"{self.top}/data/{segment.file}")
        except FileNotFoundError as error:
            if fail:
                raise LostOffsets(f"segment {segment.file} of {self.top}, offsets {segment.first} to {segment.first + segment.count - 1} of partition {segment.partition}, is gone") from error
            log.warning("segment %s of %s is skipped: it is gone", segment.file, self.top)
            return
        offset = segment.first
        with source:
            for batch in pq.ParquetFile(source).iter_batches(8192):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([segment.partition] * n, pa.int32()), pa.array(range(offset, offset + n), pa.int64()), batch.column("value")], schema=ARROW)
                offset += n

    def forget(self, keep: int) -> int:
        """Remove all but the last ``keep`` commits with their segments, and staged segments that an ended writer has left; the number of commits removed."""
        numbers = self.numbers()
        for number in numbers[: max(0, len(numbers) - keep)]:
            self.discard(self.commit(number).segments)
            self.fs.delete_file(self._file(number))
        named = {x.file for n in self.numbers() for x in self.commit(n).segments}
        for file in self.fs.get_file_info(fs.FileSelector(f"{self.top}/data", allow_not_found=True)):
            if file.base_name not in named:
                self.fs.delete_file(file.path)
        return max(0, len(numbers) - keep)


@dataclass
class Piece(InputPartition):
    segments: list[Segment]


def _pieces(segments: list[Segment]) -> list[Piece]:
    """A task for each so many rows of one partition, at least one segment."""
    out: list[Piece] = []
    for partition in sorted({x.partition for x in segments}):
        rows = READ_ROWS
        for segment in segments:
            if segment.partition != partition or not segment.count:
                continue
            if rows + segment.count > READ_ROWS:
                out.append(Piece([]))
                rows = 0
            out[-1].segments.append(segment)
            rows += segment.count
    return out


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, "true")).lower() == "true"


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fail = options["path"], _flag(options, "failOnDataLoss")

    def partitions(self) -> list[Piece]:
        folder = LogFolder(self.path)
        return _pieces(folder.between(folder.earliest(), folder.last().position(), self.fail)) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        folder = LogFolder(self.path)
        for segment in partition.segments:
            yield from folder.rows(segment, self.fail)


class _StreamReader(DataSourceStreamReader):
    """Whole commits in their order, as many a trigger as ``maxOffsetsPerTrigger`` allows, one at least.

    What a writer has put into one commit belongs to one stretch of time in all
    partitions, so a commit is never divided. Spark tells a Python reader no
    start when it asks for the latest offset; after a restart the position is
    that of the last planned batch, which is kept in the log's folder under the
    reader's ``group``. Without a group the first batch takes all that there is.
    """

    def __init__(self, options: dict):
        self.path, self.fail = options["path"], _flag(options, "failOnDataLoss")
        self.most = int(options.get("maxOffsetsPerTrigger", 10_000))
        self.group, self.starting = options.get("group"), options.get("startingOffsets", "earliest")
        self.folder = LogFolder(self.path)
        self.at: dict | None = None

    def _kept(self) -> str:
        return f"{self.folder.top}/_readers/{self.group}.json"

    def initialOffset(self) -> dict:
        self.at = self.folder.last().position() if self.starting == "latest" else self.folder.earliest()
        return self.at

    def _resumed(self) -> dict | None:
        if not self.group or self.folder.fs.get_file_info(self._kept()).type != fs.FileType.File:
            return None
        with self.folder.fs.open_input_stream(self._kept()) as file:
            return json.loads(file.read())

    def latestOffset(self) -> dict:
        if self.at is None and self.group is None:
            self.at = self.folder.last().position()
            return self.at
        self.at = self.at or self._resumed() or self.initialOffset()
        end, number = self.at, self.at["commit"] + 1
        while True:
            if not self.folder.has(number):
                later = [n for n in self.folder.numbers() if n >= number]
                if not later:
                    break
                if later[0] > number:
                    if end is not self.at:
                        break
                    if self.fail:
                        raise LostOffsets(f"commits {number} to {later[0] - 1} of {self.path} are gone")
                    number = later[0]
            found = self.folder.commit(number)
            if end is not self.at and found.records - self.at["records"] > self.most:
                break
            end, number = found.position(), number + 1
        # Not moved on yet: Spark may ask again before it plans the batch.
        return end

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        if end["commit"] < start["commit"]:
            raise LostOffsets(f"the position of reader {self.group} of {self.path} is gone: give it another group, and it reads on from its checkpoint")
        pieces = _pieces(self.folder.between(start, end, self.fail))
        if self.group:
            self.folder.fs.create_dir(f"{self.folder.top}/_readers", recursive=True)
            self.folder.put(self._kept(), json.dumps(end))
        self.at = end
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        folder = LogFolder(self.path)
        for segment in partition.segments:
            yield from folder.rows(segment, self.fail)

    def __getstate__(self) -> dict:  # tasks open the folder anew
        return self.__dict__ | {"folder": None}


@dataclass
class Staged(WriterCommitMessage):
    segments: list[Segment]


class _Writing:
    def __init__(self, options: dict):
        self.path, self.writer = options["path"], options.get("writer")
        self.batch = int(options["batch"]) if "batch" in options else None

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        return Staged(LogFolder(self.path).stage(iterator))

    def _commit(self, messages: Sequence, batch: int | None) -> None:
        """In the order of the tasks."""
        LogFolder(self.path).append([x for m in messages if m is not None for x in m.segments], self.writer, batch)

    def _abort(self, messages: Sequence) -> None:
        LogFolder(self.path).discard([x for m in messages if m is not None for x in m.segments])


class _BatchWriter(_Writing, DataSourceArrowWriter):
    def commit(self, messages: Sequence) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages: Sequence) -> None:
        self._abort(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: Sequence, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages: Sequence, batchId: int) -> None:
        self._abort(messages)


class SegmentLog(DataSource):
    """Format ``wattline_log``: reads and writes batches and streams.

    Options: path; reading also maxOffsetsPerTrigger, startingOffsets, group,
    failOnDataLoss; writing also writer and (batches) batch, by which a repeated
    batch is known.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a log is appended to")
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session.

    Its classes travel as a whole: the process in which Spark plans a Python
    stream does not get the sources that executors get.
    """
    ship(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SegmentLog)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log that are there now."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load()


def append_log(rows: DataFrame, path: str, tasks: int, writer: str | None = None, batch: int | None = None) -> None:
    """Append ``rows`` (key, value; with ``partition`` and ``timestamp``, if there, as their place) in one commit.

    Rows are dealt to ``tasks`` by ranges of (partition, timestamp), so a
    partition with most of the rows has as many tasks as its rows need, and a
    sensor's rows keep their order.
    """
    register(rows.sparkSession)
    order = [c for c in ("partition", "timestamp", "key", "value") if c in rows.columns]
    dealt = rows.repartitionByRange(tasks, *order[:-2]) if tasks > 1 and len(order) > 2 else rows.coalesce(tasks)
    kept = [c for c in ("key", "partition", "value") if c in rows.columns]
    options = {"path": path} | ({"writer": writer, "batch": str(batch)} if writer is not None and batch is not None else {})
    dealt.sortWithinPartitions(*order).select(*kept).write.format(FORMAT).options(**options).mode("append").save()


def records_behind(path: str, position: dict) -> int:
    """Records of a log beyond a reader's position."""
    return max(0, LogFolder(path).last().records - position["records"])
