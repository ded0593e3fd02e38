"""Running the two queries of the job, watching them and restarting them."""

from __future__ import annotations

import json
import logging
import threading
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from wattline.operators.enrich import enrich, orphan_summary
from wattline.operators.metrics import raw_events, windowed_metrics
from wattline.schemas import PROGRESS
from wattline.sources.log import FORMAT, register

log = logging.getLogger(__name__)
#: Seconds that a query's name may take to be free again.
RELEASE_S = 10.0


@dataclass
class JobOptions:
    """What the command line of a job offers."""

    window: str = "1 hour"
    watermark: str = "2 minutes"
    future_margin_s: float = 300.0
    trigger: str | None = "1 second"
    max_per_trigger: int = 10_000
    fail_on_data_loss: bool = True
    starting_offsets: str = "earliest"
    sink: str = "both"
    checkpoint_dir: str = "checkpoints"
    shuffle_partitions: int = 8
    max_restarts: int = 3
    supervise_every_s: float = 5.0
    #: Seconds between two writes of progress rows, and flushes between two looks for orphans.
    progress_every_s: float = 60.0
    orphan_check_every: int = 30
    write_attempts: int = 5
    write_wait_s: float = 3.0
    run_id: str = field(default_factory=lambda: datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"))

    def __post_init__(self):
        if self.sink not in ("both", "metrics", "events"):
            raise ValueError("sink must be both, metrics or events")


def kafka_options(servers: str, topic: str, options: JobOptions) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": options.starting_offsets,
        "failOnDataLoss": str(options.fail_on_data_loss).lower(), "maxOffsetsPerTrigger": str(options.max_per_trigger),
    }


def kafka_source(spark: SparkSession, servers: str, topic: str, options: JobOptions) -> DataFrame:
    """The log as a stream (needs Spark's Kafka package): stops rather than skips lost data, bounded per trigger."""
    read = spark.readStream.format("kafka").options(**kafka_options(servers, topic, options))
    return read.load().select(F.col("key").cast("string").alias("key"), "partition", "offset", "value")


def log_source(spark: SparkSession, path: str, options: JobOptions | None = None) -> Callable[[str], DataFrame]:
    """For the name of a query, the log in a folder as a stream of its own: in the order of commits, bounded a trigger, failing on lost offsets.

    Each query keeps its position under a group named after itself and its checkpoint.
    """
    options = options or JobOptions()
    register(spark)

    def stream(query: str) -> DataFrame:
        group = f"{query}-{zlib.crc32(options.checkpoint_dir.encode()):08x}"
        read = spark.readStream.format(FORMAT).option("path", path).option("group", group).option("maxOffsetsPerTrigger", options.max_per_trigger)
        return read.option("startingOffsets", options.starting_offsets).option("failOnDataLoss", str(options.fail_on_data_loss).lower()).load()

    return stream


def json_lines_source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Meters' JSON payloads, a line each, as a stream: what a broker's topic filter would deliver."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).text(path).withColumnRenamed("value", "payload")


def _start(df: DataFrame, name: str, write: Callable[[DataFrame, int], None], options: JobOptions):
    """A running query. Without a trigger it is one that ends when it has read what there is, in batches of bounded size.

    Python sources have no bounded batches under Spark's own trigger for that, so
    the query runs on and is stopped once it has nothing left to do.
    """

    def told(batch: DataFrame, batch_id: int) -> None:
        # A stop in the middle of a batch comes back as a chain of Java errors; the query gets their first line, as an error of its own.
        try:
            write(batch, batch_id)
        except Exception as error:
            log.debug("batch %d of %s failed", batch_id, name, exc_info=True)
            raise RuntimeError(f"{type(error).__name__}: {(str(error).splitlines() or [''])[0]}") from None

    ended = time.monotonic() + RELEASE_S
    while any(q.name == name for q in df.sparkSession.streams.active) and time.monotonic() < ended:
        time.sleep(0.05)  # a query that has just ended still holds its name for a moment
    writer = df.writeStream.queryName(name).outputMode("append").option("checkpointLocation", f"{options.checkpoint_dir}/{name}").foreachBatch(told)
    if options.trigger is not None:
        return writer.trigger(processingTime=options.trigger).start()
    query = writer.trigger(processingTime="0 seconds").start()

    def end() -> None:
        try:
            query.processAllAvailable()
            query.stop()
        except Exception as error:  # the supervisor sees the query's own error
            log.debug("%s ended: %s", name, error)

    threading.Thread(target=end, daemon=True).start()
    return query


Source = DataFrame | Callable[[str], DataFrame]


def query_starters(events: Source, buildings: DataFrame, baseline: DataFrame, writers: dict[str, Callable], options: JobOptions) -> dict[str, Callable]:
    """For each chosen sink a function that starts its query, with a checkpoint and a name of its own.

    ``events`` is a stream, or tells one for the name of a query.
    """
    found = {}
    of = (lambda name: events) if isinstance(events, DataFrame) else events
    if options.sink in ("both", "metrics"):
        metrics = windowed_metrics(enrich(of("metrics"), buildings, baseline), options.window, options.watermark, options.future_margin_s)
        found["metrics"] = lambda: _start(metrics, "metrics", writers["metrics"], options)
    if options.sink in ("both", "events"):
        raw = raw_events(of("events"))
        found["events"] = lambda: _start(raw, "events", writers["events"], options)
    return found


def supervise(starters: dict[str, Callable], options: JobOptions, stop: threading.Event | None = None, sleep: Callable[[float], None] = time.sleep, on_tick: Callable[[], None] | None = None) -> int:
    """Start all queries and restart each that dies, from its checkpoint, up to ``max_restarts`` times.

    Others are not touched. A query that ends without an error is finished where
    the trigger is to read what there is, and otherwise has been stopped from
    outside and is restarted too. A query whose restart fails is given up at
    once. ``on_tick`` is called in every round and once at the end. Returns 1
    when none is left because of failures, else 0.
    """
    try:
        return _supervise(starters, options, stop, sleep, on_tick or (lambda: None))
    finally:
        if on_tick is not None:
            on_tick()


def _supervise(starters: dict[str, Callable], options: JobOptions, stop: threading.Event | None, sleep: Callable[[float], None], on_tick: Callable[[], None]) -> int:
    running = {name: start() for name, start in starters.items()}
    restarts = dict.fromkeys(starters, 0)
    failed = False
    while running:
        if stop is not None and stop.is_set():
            for query in running.values():
                query.stop()
            return 0
        for name, query in list(running.items()):
            if query.isActive:
                continue
            error = query.exception()
            if error is None and options.trigger is None:
                del running[name]
                continue
            log.error("query %s died: %s", name, str(error).splitlines()[0] if error is not None else "stopped from outside")
            del running[name]
            if restarts[name] >= options.max_restarts:
                log.error("query %s given up after %d restarts", name, restarts[name])
                failed = True
                continue
            restarts[name] += 1
            try:
                running[name] = starters[name]()
            except Exception:
                log.exception("query %s could not be restarted", name)
                failed = True
        if running:
            on_tick()
            sleep(options.supervise_every_s)
    return int(failed)


def progress_row(report, run_id: str) -> dict:
    """One row of the progress table from a query's report."""
    states, sources = list(report.stateOperators), list(report.sources)
    times, durations = dict(report.eventTime or {}), dict(report.durationMs or {})
    moment = lambda text: datetime.fromisoformat(text.replace("Z", "+00:00")) if text and not text.startswith("1970-01-01T00:00:00") else None
    behind = (dict(sources[0].metrics or {}).get("maxOffsetsBehindLatest") if sources else None)
    return {
        "trigger_ts": moment(report.timestamp), "run_id": run_id, "query_name": report.name, "batch_id": report.batchId, "num_input_rows": report.numInputRows,
        "input_rows_per_second": float(report.inputRowsPerSecond or 0), "processed_rows_per_second": float(report.processedRowsPerSecond or 0),
        "duration_ms": durations.get("triggerExecution"), "add_batch_ms": durations.get("addBatch"), "query_planning_ms": durations.get("queryPlanning"), "sink_num_output_rows": report.sink.numOutputRows if report.sink else None,
        "rows_dropped_by_watermark": sum(s.numRowsDroppedByWatermark for s in states) if states else None, "offsets_behind": None if behind is None else int(float(behind)),
        "event_time_max": moment(times.get("max")), "watermark": moment(times.get("watermark")),
    }


class Invariants:
    """Warnings from successive reports of a query: stalls, and rows dropped as late."""

    def __init__(self, lag_limit: int = 1000, reports: int = 3):
        self.lag_limit, self.reports = lag_limit, reports
        self.stalled: dict[str, int] = {}
        self.dropped: dict[str, int] = {}

    def check(self, row: dict) -> list[str]:
        name, found = row["query_name"], []
        waiting = (row["offsets_behind"] or 0) > self.lag_limit and row["num_input_rows"] == 0
        self.stalled[name] = self.stalled.get(name, 0) + 1 if waiting else 0
        if self.stalled[name] >= self.reports:
            found.append(f"{name} reads nothing while {row['offsets_behind']} records wait")
        dropped = row["rows_dropped_by_watermark"] or 0
        if dropped > self.dropped.get(name, 0):
            self.dropped[name] = dropped
            found.append(f"{name} dropped {dropped} aggregated rows as late in one batch, the most so far")
        return found


class ProgressRecorder(StreamingQueryListener):
    """Keeps every report until a flush hands it to the progress table; a failed flush keeps it for the next one."""

    def __init__(self, run_id: str, write: Callable[[list[dict]], None], warn: Callable[[str], None] = log.warning, lag: Callable[[dict], int | None] | None = None):
        """``lag`` tells how many records wait beyond the position in a report, for sources that don't report it."""
        super().__init__()
        self.run_id, self.write, self.warn, self.lag = run_id, write, warn, lag
        self.pending: list[dict] = []
        self.lock = threading.Lock()
        self.invariants = Invariants()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = progress_row(event.progress, self.run_id)
        if row["offsets_behind"] is None and self.lag is not None:
            row["offsets_behind"] = self._behind(event.progress)
        with self.lock:
            self.pending.append(row)
        for text in self.invariants.check(row):
            self.warn(text)

    def _behind(self, report) -> int | None:
        try:
            return self.lag(json.loads(report.sources[0].endOffset))
        except Exception:  # a report without a position, or a log that is out of reach: not known
            log.debug("the lag of %s is not known", report.name, exc_info=True)
            return None

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self) -> int:
        """Write what is pending; returns the number of rows written. Errors are logged, never raised."""
        with self.lock:
            rows, self.pending = self.pending, []
        if not rows:
            return 0
        try:
            self.write(rows)
            return len(rows)
        except Exception:
            log.exception("progress rows could not be written")
            with self.lock:
                self.pending = rows + self.pending
            return 0


def progress_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in PROGRESS) for r in rows], PROGRESS)


class OrphanWatch:
    """Every so many flushes, counts the events without a building and warns if there are more than before."""

    def __init__(self, events: Callable[[], DataFrame], buildings: Callable[[], DataFrame], every: int = 30, warn: Callable[[str], None] = log.warning):
        self.events, self.buildings, self.every, self.warn = events, buildings, every, warn
        self.calls = self.most = 0

    def tick(self) -> None:
        self.calls += 1
        if (self.calls - 1) % self.every:
            return
        row = orphan_summary(self.events(), self.buildings()).first()
        if row["orphan_events"] > self.most:
            self.most = row["orphan_events"]
            self.warn(f"{row['orphan_events']} events of {row['orphan_buildings']} unknown buildings")
