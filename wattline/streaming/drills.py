"""Drills: load in rungs, a poisoned clock, and whether two runs came to the same tables."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions import wire
from wattline.plans.kpi import ingest_latency
from wattline.schemas import avro_schema
from wattline.sources.log import LogFolder, read_log, records_behind
from wattline.streaming.job import Tables, expected_metrics, load_references, run_ingest, run_job
from wattline.streaming.replay import replay
from wattline.streaming.runtime import JobOptions, log_source

RUNGS = "label string, sensors int, requested_rate double, published_rate double, latency_p95_s double, hot_base boolean"


def ladder(spark: SparkSession, telemetry: DataFrame, buildings: DataFrame, baseline: DataFrame, work: str, sensors: list[int], events: int, **rules) -> DataFrame:
    """One rung for each number of sensors, then the first once more, hot: replay, ingest and job from scratch.

    Payloads are sent unthrottled, so the rate requested is that of sending and
    the rate published that of sending, ingest and job together.
    """
    rows = []
    for at, n in enumerate([*sensors, sensors[0]]):
        top = f"{work.rstrip('/')}/rung{at}"
        sent = replay(telemetry, f"{top}/payloads", sensors=n, limit=events, paced=False)
        began = F.current_timestamp()
        start = spark.range(1).select(began.cast("double")).first()[0]
        totals = run_ingest(spark, f"{top}/payloads", f"{top}/log", f"{top}/dead", f"{top}/ck/ingest", avro_schema(), 1, files_per_trigger=1000, **rules)
        tables = Tables.at(spark, f"{top}/tables")
        tables.create()
        load_references(tables, buildings, baseline)
        options = JobOptions(trigger=None, checkpoint_dir=f"{top}/ck", max_per_trigger=1_000_000, supervise_every_s=0.5)
        run_job(spark, log_source(spark, f"{top}/log", options), tables, avro_schema(), 1, options)
        took = spark.range(1).select(F.current_timestamp().cast("double")).first()[0] - start
        p95 = ingest_latency(tables.events.read()).first()["latency_p95_s"]
        rows.append((f"{n} sensors" + " (hot)" * (at == len(sensors)), n, sent["events_per_second"], totals.published / (sent["seconds"] + took), p95, at == len(sensors)))
    return spark.createDataFrame(rows, RUNGS)


def failover(spark: SparkSession, log: str, tables: Tables, schema: dict, schema_id: int, options: JobOptions, kills: int = 1, most_s: float = 300.0) -> dict[str, float]:
    """Stop each query of a running job ``kills`` times from outside, and see how soon it is back and whether anything is lost.

    Returns the seconds from a stop to the query's next run, the worst of all;
    the exit code; the events that the log holds and that the table has not; and
    the rows in which the metrics differ from those that the events table gives
    for the same windows.
    """
    if options.trigger is None:
        raise ValueError("the drill needs a job that runs on, with a trigger")
    stop, waits, stopped = threading.Event(), [], {}
    left = {name: kills for name in ("metrics", "events") if options.sink in ("both", name)}
    deadline = time.monotonic() + most_s

    def watch() -> None:
        while not stop.is_set():
            running = {q.name: q for q in spark.streams.active if q.name in left}
            for name, query in running.items():
                if name in stopped and query.id and str(query.runId) != stopped[name][0]:
                    waits.append(time.monotonic() - stopped.pop(name)[1])
                if name not in stopped and left[name] and query.lastProgress is not None:
                    left[name] -= 1
                    stopped[name] = (str(query.runId), time.monotonic())
                    query.stop()
            caught_up = not stopped and not any(left.values()) and len(running) == len(left) and all(q.lastProgress is not None and q.lastProgress["numInputRows"] == 0 and not q.status["isDataAvailable"] for q in running.values())
            if caught_up or time.monotonic() > deadline:
                stop.set()
            time.sleep(0.1)

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    code = run_job(spark, log_source(spark, log, options), tables, schema, schema_id, options, stop, lag=lambda at: records_behind(log, at))
    stop.set()
    thread.join()
    events = tables.events.read()
    held = wire.decode_events(read_log(spark, log), schema, schema_id).select("building_id", "meter_type", F.col("timestamp").alias("event_time")).distinct()
    metrics = tables.metrics.read()
    shown = [c for c in metrics.columns if c not in ("ingested_at", "distinct_buildings")]
    want = expected_metrics(tables).join(metrics.select("window_start").distinct(), "window_start", "left_semi").select(shown)
    differ = want.exceptAll(metrics.select(shown)).count() + metrics.select(shown).exceptAll(want).count()
    return {"recovery_s": max(waits, default=float("nan")), "restarts": len(waits), "exit": code, "records": LogFolder(log).last().records, "events_lost": held.exceptAll(events.select(*held.columns)).count(), "metrics_differ": differ}


def poison(spark: SparkSession, payloads: str, years: int = 10, folder: str = "poison") -> None:
    """One payload, valid but for its time, from ``years`` ahead: unguarded it would close all windows."""
    ahead = F.date_format(F.current_timestamp() + F.make_interval(years=F.lit(years)), "yyyy-MM-dd'T'HH:mm:ss")
    record = F.to_json(F.struct(F.lit("0").alias("building_id"), F.lit("electricity").alias("meter_type"), ahead.alias("timestamp"), F.lit(1.0).alias("meter_reading"), F.unix_millis(F.current_timestamp()).alias("sim_publish_ts")))
    spark.range(1).select(record.alias("value")).write.mode("overwrite").text(f"{payloads.rstrip('/')}/{folder}")


def same_tables(one: Tables, other: Tables) -> dict[str, int]:
    """Rows that only one of two runs has, by table; moments of writing and sending do not count, nor approximate counts."""
    found = {}
    for name, left, right in (("events", one.events, other.events), ("metrics", one.metrics, other.metrics)):
        shown = [c for c in left.schema.fieldNames() if c not in ("ingested_at", "sim_publish_ts", "max_sim_publish_ts", "distinct_buildings")]
        a, b = left.read().select(shown), right.read().select(shown)
        found[name] = a.exceptAll(b).count() + b.exceptAll(a).count()
    return found
