"""The runnable job: from a log to the tables, watched and restarted, and what its command line needs."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions import wire
from wattline.operators.enrich import enrich
from wattline.operators.metrics import METRICS, windowed_metrics
from wattline.schemas import BASELINE, BUILDINGS, EVENT, METRIC_KEY, PROGRESS, PROGRESS_KEY
from wattline.streaming.ingest import IngestTotals, ingest_writer
from wattline.streaming.runtime import JobOptions, OrphanWatch, ProgressRecorder, Source, json_lines_source, progress_frame, query_starters, supervise
from wattline.streaming.sinks import KeyedTable, log_writer, upsert_writer

log = logging.getLogger(__name__)
RAW_KEY = ["building_id", "meter_type", "event_time"]


def _stamped(fields: T.StructType) -> T.StructType:
    return T.StructType([*fields.fields, T.StructField("ingested_at", T.TimestampType())])


@dataclass
class Tables:
    """The job's tables under one folder; ``create`` makes those that are missing and leaves the others alone."""

    events: KeyedTable
    metrics: KeyedTable
    progress: KeyedTable
    buildings: KeyedTable
    baseline: KeyedTable

    @classmethod
    def at(cls, spark: SparkSession, top: str) -> Tables:
        raw = T.StructType([T.StructField("event_time", f.dataType) if f.name == "timestamp" else f for f in EVENT])
        return cls(
            KeyedTable(spark, f"{top}/events", _stamped(raw), RAW_KEY, ["sim_publish_ts", "ingested_at"], "event_time"),
            KeyedTable(spark, f"{top}/metrics", _stamped(METRICS), METRIC_KEY, ["max_sim_publish_ts", "ingested_at"], "window_start"),
            KeyedTable(spark, f"{top}/progress", PROGRESS, PROGRESS_KEY, ["duration_ms"], "trigger_ts"),
            KeyedTable(spark, f"{top}/buildings", BUILDINGS, ["building_id"], ["square_feet"]),
            KeyedTable(spark, f"{top}/baseline", BASELINE, ["building_id", "meter_type"], ["baseline_p50"]),
        )

    def all(self) -> list[KeyedTable]:
        return [self.events, self.metrics, self.progress, self.buildings, self.baseline]

    def create(self) -> None:
        for table in self.all():
            table.create()


def load_references(tables: Tables, buildings: DataFrame, baseline: DataFrame) -> None:
    """Upsert the reference tables; with the same rows again nothing changes."""
    fit = lambda df, schema: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    tables.buildings.upsert(fit(buildings, BUILDINGS))
    tables.baseline.upsert(fit(baseline, BASELINE))


def _references(tables: Tables) -> tuple[DataFrame, DataFrame]:
    buildings = tables.buildings.read().select("building_id", "site_id", "primary_use", F.col("square_feet").cast("double").alias("square_feet"))
    return buildings, tables.baseline.read().select("building_id", "meter_type", "baseline_p75", "baseline_iqr")


def both(first: Callable, second: Callable) -> Callable[[DataFrame, int], None]:
    """One ``foreachBatch`` function of two; the batch is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            first(batch, batch_id)
            second(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def run_job(spark: SparkSession, source: Source, tables: Tables, schema: dict, schema_id: int, options: JobOptions, stop: threading.Event | None = None, sleep: Callable[[float], None] = time.sleep, on_collision: Callable[[DataFrame], None] | None = None, lag: Callable[[dict], int | None] | None = None, also: dict[str, Callable[[DataFrame, int], None]] | None = None, known: dict[int, dict] | None = None) -> int:
    """Run the queries over the log ``source`` until they end or ``stop`` is set; 0, or 1 if one was given up.

    ``also`` names further writers for the batches of a query, such as one to a
    database; ``lag`` tells how many records wait beyond a position; ``known`` are
    the schemas, by id, of records that are resolved to ``schema``.

    Reports of all batches go to the progress table, the last ones after the
    queries have ended; events of unknown buildings are looked for now and then.
    The reference tables are read as of now, and stay as they are for this run.
    """
    tables.create()
    of = (lambda name: source) if isinstance(source, DataFrame) else source
    warn = on_collision or (lambda found: log.warning("%d keys came with different readings", found.count()))
    settings = {"attempts": options.write_attempts, "wait_s": options.write_wait_s}
    writers = {"metrics": upsert_writer(tables.metrics, **settings), "events": upsert_writer(tables.events, on_collision=warn, **settings)}
    for name, more in (also or {}).items():
        writers[name] = both(writers[name], more)
    recorder = ProgressRecorder(options.run_id, lambda rows: tables.progress.insert_ignore(progress_frame(spark, rows)), lag=lag)
    orphans = OrphanWatch(lambda: tables.events.read(), lambda: tables.buildings.read(), options.orphan_check_every)
    flushed = [time.monotonic()]

    def tick() -> None:
        if time.monotonic() - flushed[0] >= options.progress_every_s:
            flushed[0] = time.monotonic()
            recorder.flush()
            orphans.tick()

    spark.streams.addListener(recorder)
    try:
        with tables.buildings.pinned(), tables.baseline.pinned():
            buildings, baseline = _references(tables)
            starters = query_starters(lambda name: wire.decode_events(of(name), schema, schema_id, known), buildings, baseline, writers, options)
            return supervise(starters, options, stop, sleep, tick)
    finally:
        settled, most = -1, time.monotonic() + 5
        while settled != len(recorder.pending) and time.monotonic() < most:  # reports come a little after their batches
            settled = len(recorder.pending)
            time.sleep(0.5)
        spark.streams.removeListener(recorder)
        recorder.flush()
        orphans.tick()


def run_ingest(spark: SparkSession, payloads: str, log_path: str, dead_letters: str, checkpoint: str, schema: dict, schema_id: int, trigger: str | None = None, files_per_trigger: int = 1, report_every: int = 0, **rules) -> IngestTotals:
    """Read JSON lines as they come (or, without a trigger, those that are there) into the log and the dead letters."""
    totals = IngestTotals()
    write = ingest_writer(log_writer(log_path), log_writer(dead_letters), schema, schema_id, totals, report_every=report_every, **rules)
    query = json_lines_source(spark, payloads, files_per_trigger).writeStream.queryName("ingest").option("checkpointLocation", checkpoint).foreachBatch(write)
    query = (query.trigger(availableNow=True) if trigger is None else query.trigger(processingTime=trigger)).start()
    query.awaitTermination()
    return totals


def expected_metrics(tables: Tables) -> DataFrame:
    """The metrics that follow from the events table: what a run, however often broken off, must have arrived at."""
    events = tables.events.read().withColumnRenamed("event_time", "timestamp")
    return windowed_metrics(enrich(events, *_references(tables)), margin_s=None)
