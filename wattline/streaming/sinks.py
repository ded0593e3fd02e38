"""Sinks: idempotent merges, dead letters, DB-API upserts, with retries for lost connections only."""

from __future__ import annotations

import json
import logging
import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.dedup import dedup_first, dedup_last, key_collisions
from wattline.schemas import INSTRUMENTATION
from wattline.sources.log import append_log

log = logging.getLogger(__name__)
Writer = Callable[[DataFrame, int], None]


def with_retries(action: Callable[[], None], attempts: int = 5, wait_s: float = 3.0, retry_on: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> None:
    """Run ``action``; after a connectivity error wait and try again, ``attempts`` times in all; other errors pass at once."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except retry_on as error:
            if attempt == attempts:
                raise
            log.warning("attempt %d of %d failed: %s", attempt, attempts, error)
            sleep(wait_s)


@dataclass(frozen=True)
class Run:
    """Rows of one partition that one merge has written, one a key: where, how many, the range of their times in microseconds."""

    folder: str
    seq: int
    rows: int
    low: int | None = None
    high: int | None = None
    ignores: bool = False

    @property
    def rank(self) -> int:
        """Of rows with one key, that of the largest rank stands: the last upsert, else the first insert that would ignore others."""
        return -self.seq if self.ignores else self.seq


#: A partition's rows, and the range of their times in microseconds.
Extent = tuple[int, int | None, int | None]


class KeyedTable:
    """A keyed Parquet table that is merged on reading: a merge writes its own rows only, as a new run, then commits.

    A partition is a list of runs; a commit is a numbered file with the runs of
    the partitions that it changes, and now and then of all. It comes into
    being by a rename, so after a crash at any step the last commit still stands,
    with whole files. A repeated merge of the same rows gives the same table, so a
    batch that is replayed after a failure is harmless. ``partition_by`` names a
    time column whose days are the partitions; without it the table is one.

    Reading, runs of a partition whose times do not meet are read as they are;
    others are merged by key. Once ``fan`` runs of about one size have come
    together they are written as one, so a row is rewritten about as often as the
    logarithm of the partition's size says. Folders that none of the last
    ``keep`` commits names are removed now and then, so readers of recent
    versions are not disturbed, nor those who hold a version by ``pinned``. One
    writer at a time.
    """

    FULL_EVERY = 16
    #: A pin of a reader that never came back is ignored after so long.
    PIN_DAYS = 30

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], order: list[str], partition_by: str | None = None, keep: int = 10, fan: int = 8, rows_per_file: int = 500_000):
        self.spark, self.path, self.keys, self.order, self.partition_by, self.keep, self.fan, self.rows_per_file = spark, path.rstrip("/"), keys, order, partition_by, keep, fan, rows_per_file
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._known: dict[int, dict[str, list[Run]]] = {}  # commits never change

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return at, at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        at, fs = self._fs()
        where = at(f"{self.path}/{folder}")
        return [(f.getPath().getName(), f.getModificationTime()) for f in fs.listStatus(where)] if fs.exists(where) else []

    def commits(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self._names("_commits") if n.endswith(".json"))

    def _load(self, commit: int) -> dict:
        at, fs = self._fs()
        stream = fs.open(at(f"{self.path}/_commits/{commit:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, commit: int | None = None) -> dict[str, list[Run]]:
        """The runs of each partition, of the last commit or a given one."""
        if commit is None:
            found = self.commits()
            if not found:
                return {}
            commit = found[-1]
        chain = []
        while commit not in self._known:
            raw = self._load(commit)
            chain.append((commit, {d: [Run(*x) for x in runs] for d, runs in raw["days"].items()}, raw["full"]))
            if raw["full"]:
                break
            commit -= 1
        else:
            chain.append((commit, self._known[commit], True))
        now: dict[str, list[Run]] = {}
        for n, days, full in reversed(chain):
            now = days if full else now | days
            self._known[n] = now
        return now

    def create(self) -> bool:
        """An empty table, unless there is one; tells whether it was made."""
        if self.commits():
            return False
        self._commit({})
        return True

    def read(self, commit: int | None = None, days: list[str] | None = None) -> DataFrame:
        """The rows, of the last commit or a given one, of all partitions or of ``days`` alone."""
        found = self.manifest(commit)
        return self._merged(self._clusters(found if days is None else {d: found[d] for d in days if d in found}))

    @staticmethod
    def _clusters(manifest: dict[str, list[Run]]) -> list[list[Run]]:
        """Runs of one partition whose ranges of time meet, directly or through others; a run without a range meets all."""
        out: list[list[Run]] = []
        for runs in manifest.values():
            if any(r.low is None or r.high is None for r in runs):
                out.append(runs)
                continue
            reach = None
            for run in sorted(runs, key=lambda r: (r.low, r.high)):
                if reach is not None and run.low <= reach:
                    out[-1].append(run)
                    reach = max(reach, run.high)
                else:
                    out.append([run])
                    reach = run.high
        return out

    def _merged(self, clusters: list[list[Run]]) -> DataFrame:
        alone = [c[0].folder for c in clusters if len(c) == 1]
        together = [r for c in clusters if len(c) > 1 for r in c]
        reader = self.spark.read.schema(self.schema)
        parts = []
        if alone:
            parts.append(reader.parquet(*[f"{self.path}/{x}" for x in sorted(alone)]).select(*self.schema.names))
        if together:
            ranks = {r.folder.split("/")[1]: r.rank for r in together}
            rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1)]
            rows = reader.parquet(*[f"{self.path}/{r.folder}" for r in together]).select(*self.schema.names, rank.alias("_rank"))
            parts.append(dedup_last(rows, self.keys, ["_rank"]).select(*self.schema.names))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])

    def day(self) -> Column:
        """The partition of a row."""
        return F.coalesce(F.date_format(self.partition_by, "yyyy-MM-dd"), F.lit("none")) if self.partition_by else F.lit("all")

    def extent(self) -> list[Column]:
        """Aggregates of a partition's rows: n, low, high."""
        micros = F.unix_micros(self.partition_by) if self.partition_by else F.lit(None).cast("long")
        return [F.count("*").alias("n"), F.min(micros).alias("low"), F.max(micros).alias("high")]

    def _commit(self, changes: dict[str, list[Run]]) -> None:
        """The partitions that change, with all of their runs."""
        at, fs = self._fs()
        last = (self.commits() or [0])[-1]
        n = last + 1
        full = n % self.FULL_EVERY == 1 or not last
        days = (self.manifest(last) if last else {}) | changes if full else changes
        draft, final = at(f"{self.path}/_commits/{uuid.uuid4().hex}.draft"), at(f"{self.path}/_commits/{n:012d}.json")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"full": full, "days": {d: [astuple(r) for r in runs] for d, runs in days.items()}}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"{self.path} has another writer")

    def _write(self, rows: DataFrame, count: int) -> str:
        """Rows as new files, a folder a partition: the name of the folder above them.

        Rows are shuffled to the tasks that write: with ``coalesce`` those few
        tasks would also do all that makes up the rows.
        """
        fresh = f"data/{uuid.uuid4().hex}"
        rows.withColumn("part_day", self.day()).repartition(1 + count // self.rows_per_file, *self.keys).write.partitionBy("part_day").parquet(f"{self.path}/{fresh}")
        return fresh

    def _merge(self, rows: DataFrame, ignores: bool, days: dict[str, Extent] | None) -> None:
        rows, now = rows.select(*self.schema.names), self.manifest()
        if days is None:
            days = {r["day"]: (r["n"], r["low"], r["high"]) for r in rows.groupBy(self.day().alias("day")).agg(*self.extent()).collect()}  # those of one batch
        if not days:
            return
        seq = (self.commits() or [0])[-1] + 1
        fresh = self._write(dedup_first(rows, self.keys, self.order) if ignores else dedup_last(rows, self.keys, self.order), sum(n for n, _, _ in days.values()))
        changes = {d: [*now.get(d, []), Run(f"{fresh}/part_day={d}", seq, *extent, ignores)] for d, extent in days.items()}
        self._commit(changes | self._compacted(changes))
        self._vacuum()

    def _span(self, runs: list[Run]) -> int:
        """The first of the last runs that are to become one; their number if none are."""
        tier = lambda rows: int(math.log(max(rows, 1), self.fan))
        at, made, level = len(runs), 0, tier(runs[-1].rows)
        while True:
            first = at
            while first and tier(runs[first - 1].rows) <= level:
                first -= 1
            if at - first + (made > 0) < self.fan:
                break
            at = first
            made = sum(r.rows for r in runs[at:])
            level = tier(made)  # what these make up may be the last that its own size needs
        return at if len({r.ignores for r in runs[at:]}) <= 1 else 0  # of mixed runs only the oldest may be written as one

    def _compacted(self, changes: dict[str, list[Run]]) -> dict[str, list[Run]]:
        spans = {d: at for d, runs in changes.items() if (at := self._span(runs)) < len(runs) - 1}
        if not spans:
            return {}
        old = {d: changes[d][at:] for d, at in spans.items()}
        merged = self._merged(self._clusters(old))
        fresh = self._write(merged, sum(r.rows for runs in old.values() for r in runs))
        out = {}
        for d, runs in old.items():
            lows, highs = [r.low for r in runs], [r.high for r in runs]
            low, high = (min(lows), max(highs)) if None not in lows + highs else (None, None)
            out[d] = [*changes[d][: spans[d]], Run(f"{fresh}/part_day={d}", runs[-1].seq, sum(r.rows for r in runs), low, high, runs[0].ignores and spans[d] > 0)]
        return out

    def _vacuum(self) -> None:
        commits = self.commits()
        if len(commits) < 2 * self.keep:
            return
        at, fs = self._fs()
        oldest = time.time() * 1000 - self.PIN_DAYS * 86_400_000
        pins = [int(n.split("-")[0]) for n, moment in self._names("_pins") if n.endswith(".pin") and moment > oldest]
        first = min([commits[-self.keep], *pins])
        used = {run.folder.split("/")[1] for n in commits if n >= first for runs in self.manifest(n).values() for run in runs}
        # A commit that tells changes only needs those before it, back to a whole one.
        whole = max((n for n in commits if n <= first and n % self.FULL_EVERY == 1), default=commits[0])
        for n in commits:
            if n < whole:
                fs.delete(at(f"{self.path}/_commits/{n:012d}.json"), False)
                self._known.pop(n, None)
        for name, _ in self._names("data"):
            if name not in used:
                fs.delete(at(f"{self.path}/data/{name}"), True)

    @contextmanager
    def pinned(self) -> Iterator[int]:
        """Keep the files of the last commit while this is open."""
        at, fs = self._fs()
        commit = (self.commits() or [0])[-1]
        pin = at(f"{self.path}/_pins/{commit:012d}-{uuid.uuid4().hex}.pin")
        fs.create(pin).close()
        try:
            yield commit
        finally:
            fs.delete(pin, False)

    def upsert(self, rows: DataFrame, days: dict[str, Extent] | None = None) -> None:
        """Merge rows in; ``days``, where the caller knows them, are the partitions that the rows touch."""
        self._merge(rows, False, days)

    def insert_ignore(self, rows: DataFrame, days: dict[str, Extent] | None = None) -> None:
        self._merge(rows, True, days)

    def truncate(self) -> None:
        at, fs = self._fs()
        fs.delete(at(self.path), True)
        self._known.clear()


def upsert_writer(table: KeyedTable, attempts: int = 5, wait_s: float = 3.0, on_collision: Callable[[DataFrame], None] | None = None) -> Writer:
    """A ``foreachBatch`` function: merge the batch, computed once, into the table; an empty batch does nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            # One pass tells the days that the batch touches, their extents, and how many keys come with different readings.
            domain = [c for c in batch.columns if c not in table.keys and c not in INSTRUMENTATION]
            told = F.xxhash64(*domain) if domain else F.lit(0)
            by_key = batch.groupBy(*table.keys, table.day().alias("day")).agg((F.min(told) != F.max(told)).alias("collides"))
            days = {r["day"]: ((r["n"], r["low"], r["high"]), r["collisions"]) for r in by_key.groupBy("day").agg(*table.extent(), F.count_if("collides").alias("collisions")).collect()}
            if not days:
                return
            if on_collision is not None and any(n for _, n in days.values()):
                on_collision(key_collisions(batch, table.keys))
            stamped = batch.withColumn("ingested_at", F.current_timestamp()) if "ingested_at" in table.schema.fieldNames() and "ingested_at" not in batch.columns else batch
            with_retries(lambda: table.upsert(stamped, {d: extent for d, (extent, _) in days.items()}), attempts, wait_s)
        finally:
            batch.unpersist()

    return write


def log_writer(path: str, writer: str = "ingest", rows_per_task: int = 200_000) -> Writer:
    """A ``foreachBatch`` function that appends a batch to a log in one commit; a batch that is replayed changes nothing.

    Rows have key and value, and perhaps partition and timestamp. ``rows``, where
    the caller knows their number, spares small batches a shuffle to many tasks.
    """

    def write(batch: DataFrame, batch_id: int, rows: int | None = None) -> None:
        most = max(1, int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        append_log(batch, path, most if rows is None else min(most, 1 + rows // rows_per_task), writer, batch_id)

    return write


def kafka_write_options(servers: str, topic: str) -> dict[str, str]:
    """Every replica confirms, and a retried send is not written twice."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.linger.ms": "5", "kafka.compression.type": "lz4"}


def kafka_writer(servers: str, topic: str, attempts: int = 5, wait_s: float = 3.0) -> Writer:
    """A ``foreachBatch`` function that sends key and value to a topic (needs Spark's Kafka package)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
        with_retries(lambda: rows.write.format("kafka").options(**kafka_write_options(servers, topic)).save(), attempts, wait_s)

    return write


_SQL_TYPES = {"string": "text", "int": "integer", "bigint": "bigint", "double": "double precision", "timestamp": "timestamp with time zone", "boolean": "boolean", "binary": "blob"}


def create_sql(table: str, schema: T.StructType, keys: list[str], indexes: list[list[str]] = ()) -> list[str]:
    """Statements that make a keyed table and its indexes where they are missing, and otherwise do nothing."""
    columns = [f"{f.name} {_SQL_TYPES[f.dataType.simpleString()]}" for f in schema]
    made = [f"create table if not exists {table} ({', '.join(columns)}, primary key ({', '.join(keys)}))"]
    return made + [f"create index if not exists {table}_{'_'.join(x)} on {table} ({', '.join(x)})" for x in indexes]


def ensure_table(connect: Callable[[], object], table: str, schema: T.StructType, keys: list[str], indexes: list[list[str]] = ()) -> None:
    connection = connect()
    try:
        cursor = connection.cursor()
        for statement in create_sql(table, schema, keys, indexes):
            cursor.execute(statement)
        connection.commit()
    finally:
        connection.close()


def upsert_sql(table: str, columns: list[str], keys: list[str]) -> str:
    """An upsert that replaces every other column, in the dialect that SQLite and PostgreSQL share."""
    rest = [c for c in columns if c not in keys]
    action = "do update set " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "do nothing"
    return f"insert into {table} ({', '.join(columns)}) values ({', '.join('?' * len(columns))}) on conflict ({', '.join(keys)}) {action}"


def dbapi_writer(connect: Callable[[], object], table: str, keys: list[str], order: list[str], page: int = 500, attempts: int = 5, wait_s: float = 3.0) -> Writer:
    """A ``foreachBatch`` function that upserts each partition over a connection of its own, a page at a time.

    Duplicates are merged in Spark first, by the last in ``order``; rows go from
    the executors to the database without passing the driver.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = dedup_last(batch, keys, order)
        columns = rows.columns
        sql = upsert_sql(table, columns, keys)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = 0
            for part in batches:
                values = [tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in r.values()) for r in part.to_pylist()]

                def store() -> None:
                    connection = connect()
                    try:
                        cursor = connection.cursor()
                        for at in range(0, len(values), page):
                            cursor.executemany(sql, values[at : at + page])
                        connection.commit()
                    finally:
                        connection.close()

                with_retries(store, attempts, wait_s)
                sent += len(values)
            yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64())], names=["sent"])

        rows.mapInArrow(send, "sent long").agg(F.sum("sent")).collect()

    return write
