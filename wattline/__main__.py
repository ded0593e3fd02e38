"""Command line: ``python -m wattline COMMAND``; every command is a thin call of the library."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.prepare import prepare, write_prepared
from wattline.plans.kpi import measured, panel_times, report
from wattline.plans.panels import PANELS, View
from wattline.plans.rollups import Rollups, routed
from wattline.schemas import RAW_READINGS, avro_schema
from wattline.sources.log import records_behind
from wattline.sources.readers import SchemaCatalog, load_reference, read_any, read_excel
from wattline.streaming.drills import failover, ladder, poison, same_tables
from wattline.streaming.job import Tables, both, load_references, run_ingest, run_job
from wattline.streaming.replay import replay
from wattline.streaming.reset import reset_state
from wattline.streaming.runtime import JobOptions, kafka_source, log_source
from wattline.streaming.sinks import dbapi_writer, ensure_table

NAME = "telemetry"


def session(partitions: int) -> SparkSession:
    made = SparkSession.builder.appName("wattline").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC")
    return made.getOrCreate()


def _connect(module: str, address: str):
    """A connection of a DB-API module, made where it is used."""
    return importlib.import_module(module).connect(address)


def _routed(rollups: Rollups, name: str, metrics: DataFrame, view: View) -> DataFrame:
    return routed(rollups, name, view)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m wattline", description="Analytics on metered telemetry.")
    top.add_argument("--shuffle-partitions", type=int, default=8)
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("prepare", help="raw readings and metadata to telemetry, buildings and baseline")
    p.add_argument("train")
    p.add_argument("metadata")
    p.add_argument("out")
    p.add_argument("--sites", type=int, nargs="+", default=[2, 3, 5])

    p = commands.add_parser("excel", help="a spreadsheet to Parquet")
    p.add_argument("path")
    p.add_argument("out")

    p = commands.add_parser("register", help="register the event's schema, or show that it is registered")
    p.add_argument("catalog")
    p.add_argument("--version", type=int, default=1)

    p = commands.add_parser("simulate", help="send prepared telemetry as JSON lines, at its own pace")
    p.add_argument("telemetry")
    p.add_argument("out")
    p.add_argument("--speedup", type=float, default=1000.0)
    p.add_argument("--connections", type=int, default=4)
    p.add_argument("--sensors", type=int)
    p.add_argument("--limit", type=int)
    p.add_argument("--slice", type=float, default=1.0)
    p.add_argument("--unpaced", action="store_true")
    p.add_argument("--now", action="store_true", help="shift all times so that the last event is now")
    p.add_argument("--end", help="shift all times so that the last event is at this time")
    p.add_argument("--max-lag", type=float, help="give up once a slice is so many seconds late")
    p.add_argument("--attempts", type=int, default=5, help="how often a slice is tried when the connection fails")
    p.add_argument("--retry-wait", type=float, default=3.0)

    p = commands.add_parser("ingest", help="JSON lines to the log, rejected ones to the dead letters")
    p.add_argument("payloads")
    p.add_argument("log")
    p.add_argument("dead_letters")
    p.add_argument("--catalog", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--trigger", help="time between two batches, in which payloads gather; without it, read what there is and end")
    p.add_argument("--files-per-trigger", type=int, default=1)
    p.add_argument("--future-margin", type=float, default=300.0)
    p.add_argument("--report-every", type=int, default=30, help="log the totals every so many batches")

    p = commands.add_parser("stream", help="the log to metrics and events, watched and restarted")
    p.add_argument("log", help="a folder, or host:port/topic of a broker")
    p.add_argument("tables")
    p.add_argument("--catalog", required=True)
    p.add_argument("--dimension", help="prepared buildings, to be loaded first")
    p.add_argument("--baseline", help="prepared baseline, to be loaded first")
    p.add_argument("--checkpoint", default="checkpoints")
    p.add_argument("--sink", choices=["both", "metrics", "events"], default="both")
    p.add_argument("--window", default="1 hour")
    p.add_argument("--watermark", default="2 minutes")
    p.add_argument("--future-margin", type=float, default=300.0)
    p.add_argument("--trigger", default="1 second")
    p.add_argument("--once", action="store_true", help="read what there is, then end")
    p.add_argument("--starting-offsets", choices=["earliest", "latest"], default="earliest")
    p.add_argument("--max-per-trigger", type=int, default=10_000)
    p.add_argument("--allow-data-loss", action="store_true")
    p.add_argument("--max-restarts", type=int, default=3)
    p.add_argument("--supervise-every", type=float, default=5.0, help="seconds between two looks at the queries")
    p.add_argument("--progress-every", type=float, default=60.0, help="seconds between two writes of progress rows")
    p.add_argument("--orphan-every", type=int, default=30, help="look for events of unknown buildings at every so many writes of progress")
    p.add_argument("--write-attempts", type=int, default=5)
    p.add_argument("--write-wait", type=float, default=3.0)
    p.add_argument("--run-id")
    p.add_argument("--rollups", action="store_true", help="keep roll-ups of the metrics beside the tables")
    p.add_argument("--database", help="module:address of a DB-API database that gets metrics and events too")

    p = commands.add_parser("failover", help="stop each query of a running job from outside; how soon it is back, and is anything lost")
    p.add_argument("log")
    p.add_argument("tables")
    p.add_argument("--catalog", required=True)
    p.add_argument("--checkpoint", default="checkpoints")
    p.add_argument("--kills", type=int, default=1)
    p.add_argument("--seconds", type=float, default=300.0, help="end after so long at the latest")
    p.add_argument("--max-per-trigger", type=int, default=10_000)

    p = commands.add_parser("report", help="indicators of a run against their targets, as Markdown")
    p.add_argument("tables")
    p.add_argument("--published", type=int)
    p.add_argument("--valid", type=int)
    p.add_argument("--rejected", type=int)
    p.add_argument("--panels", action="store_true", help="time the dashboard's panels too")
    p.add_argument("--run-id", help="the run whose batches count; without it the last one")
    p.add_argument("--rollups", action="store_true", help="time the panels on the roll-ups where they hold the answer")
    p.add_argument("--from", dest="since", help="the panels' range of time")
    p.add_argument("--to", dest="until")

    p = commands.add_parser("ladder", help="the whole way under growing load, a rung for each number of sensors")
    p.add_argument("telemetry")
    p.add_argument("dimension")
    p.add_argument("baseline")
    p.add_argument("work")
    p.add_argument("--rungs", type=int, nargs="+", default=[100, 250, 500])
    p.add_argument("--events", type=int, default=20_000)

    p = commands.add_parser("poison", help="put one event from far ahead into a folder of payloads")
    p.add_argument("payloads")
    p.add_argument("--years", type=int, default=10)

    p = commands.add_parser("compare", help="do two runs have the same tables")
    p.add_argument("one")
    p.add_argument("other")

    p = commands.add_parser("reset", help="remove checkpoints, logs and tables")
    p.add_argument("tables")
    p.add_argument("--checkpoint", default="checkpoints")
    p.add_argument("--logs", nargs="*", default=[])
    p.add_argument("--everything", action="store_true", help="the reference tables too")
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.command == "register":
        number, new = SchemaCatalog(a.catalog).register(NAME, avro_schema(a.version))
        print(json.dumps({"id": number, "new": new}))
        return 0
    spark = session(a.shuffle_partitions)
    if a.command == "prepare":
        write_prepared(*prepare(read_any(spark, a.train, RAW_READINGS), read_any(spark, a.metadata), a.sites), a.out)
    elif a.command == "excel":
        read_excel(spark, a.path).write.mode("overwrite").parquet(a.out)
    elif a.command == "simulate":
        events = read_any(spark, a.telemetry)
        print(json.dumps(replay(events, a.out, a.speedup, a.connections, a.sensors, a.limit, a.slice, not a.unpaced, F.current_timestamp() if a.now else F.lit(a.end).cast("timestamp") if a.end else None, a.max_lag, a.attempts, a.retry_wait)))
    elif a.command == "ingest":
        number, schema = SchemaCatalog(a.catalog).latest(NAME)
        totals = run_ingest(spark, a.payloads, a.log, a.dead_letters, a.checkpoint, schema, number, a.trigger, a.files_per_trigger, a.report_every, margin_s=a.future_margin)
        print(json.dumps({"received": totals.received, "published": totals.published, "rejected": totals.rejected, "lost": totals.lost, "reasons": totals.reasons}))
    elif a.command == "stream":
        options = JobOptions(
            window=a.window, watermark=a.watermark, future_margin_s=a.future_margin, trigger=None if a.once else a.trigger, max_per_trigger=a.max_per_trigger, fail_on_data_loss=not a.allow_data_loss, starting_offsets=a.starting_offsets, sink=a.sink,
            checkpoint_dir=a.checkpoint, max_restarts=a.max_restarts, supervise_every_s=a.supervise_every, progress_every_s=a.progress_every, orphan_check_every=a.orphan_every, write_attempts=a.write_attempts, write_wait_s=a.write_wait,
        )
        options.run_id = a.run_id or options.run_id
        catalog = SchemaCatalog(a.catalog)
        number, schema = catalog.latest(NAME)
        tables = Tables.at(spark, a.tables)
        tables.create()
        if a.dimension and a.baseline:
            load_reference(spark, a.dimension, a.baseline)  # says what is missing
            load_references(tables, spark.read.parquet(a.dimension), spark.read.parquet(a.baseline))
        servers, _, topic = a.log.rpartition("/")
        broker = ":" in servers and "//" not in a.log
        source = kafka_source(spark, servers, topic, options) if broker else log_source(spark, a.log, options)
        also = {}
        if a.database:
            module, _, address = a.database.partition(":")
            connect = partial(_connect, module, address)
            for name, table in (("metrics", tables.metrics), ("events", tables.events)):
                ensure_table(connect, name, table.schema, table.keys)
                also[name] = dbapi_writer(connect, name, table.keys, [c for c in table.order if c != "ingested_at"], attempts=a.write_attempts, wait_s=a.write_wait)
        if a.rollups:
            follow = Rollups(spark, f"{a.tables}/rollups", tables.metrics).follow
            also["metrics"] = both(follow, also["metrics"]) if "metrics" in also else follow
        return run_job(spark, source, tables, schema, number, options, lag=None if broker else lambda at: records_behind(a.log, at), also=also, known=catalog.all_of(NAME))
    elif a.command == "failover":
        number, schema = SchemaCatalog(a.catalog).latest(NAME)
        options = JobOptions(checkpoint_dir=a.checkpoint, supervise_every_s=1.0, trigger="200 milliseconds", max_restarts=a.kills + 3, max_per_trigger=a.max_per_trigger)
        found = failover(spark, a.log, Tables.at(spark, a.tables), schema, number, options, a.kills, a.seconds)
        print(json.dumps(found))
        return int(found["exit"] != 0 or found["events_lost"] > 0 or found["metrics_differ"] > 0)
    elif a.command == "report":
        t = Tables.at(spark, a.tables)
        view = View(**{k: v for k, v in (("start", a.since), ("end", a.until)) if v})
        panel_s = None
        if a.panels:
            rolled = Rollups(spark, f"{a.tables}/rollups", t.metrics) if a.rollups else None
            panels = {name: partial(_routed, rolled, name) for name in PANELS} if rolled else None
            panel_s = max(panel_times(t.metrics.read().cache(), view, panels=panels).values())
        print(report(measured(t.events.read(), t.metrics.read(), t.progress.read(), a.valid, a.rejected, a.published, panel_s=panel_s, run_id=a.run_id)))
    elif a.command == "ladder":
        rungs = ladder(spark, read_any(spark, a.telemetry), spark.read.parquet(a.dimension), spark.read.parquet(a.baseline), a.work, a.rungs, a.events)
        for r in rungs.collect():
            print(json.dumps(r.asDict()))
    elif a.command == "poison":
        poison(spark, a.payloads, a.years, f"poison={int(time.time())}")
    elif a.command == "compare":
        differ = same_tables(Tables.at(spark, a.one), Tables.at(spark, a.other))
        print(json.dumps(differ))
        return int(any(differ.values()))
    elif a.command == "reset":
        t = Tables.at(spark, a.tables)
        reset_state(spark, a.checkpoint, [t.events, t.metrics, t.progress], [t.buildings, t.baseline], a.everything, a.logs)
    return 0


if __name__ == "__main__":
    sys.exit(main())
