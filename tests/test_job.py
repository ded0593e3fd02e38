"""The runnable job end to end: ingest, stream, a killed query, restart, report, and its command line."""

import json
import os
import sqlite3
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattline.__main__ import main, parser
from wattline.functions import wire
from wattline.operators.contract import log_depth
from wattline.operators.metrics import closed_windows
from wattline.operators.prepare import prepare, write_prepared
from wattline.plans.kpi import TARGETS, measured, panel_times, progress_of, report
from wattline.plans.panels import PANELS, View
from wattline.plans.rollups import Rollups
from wattline.schemas import METER_CODES, PROGRESS, avro_schema
from wattline.sources.log import LogFolder, append_log, read_log, records_behind
from wattline.streaming.drills import ladder, poison, same_tables
from wattline.streaming.ingest import DropCounter, IngestTotals, ingest_writer
from wattline.streaming.job import Tables, expected_metrics, load_references, run_ingest, run_job
from wattline.streaming.replay import replay
from wattline.streaming.reset import reset_state
from wattline.streaming.runtime import JobOptions, ProgressRecorder, kafka_options, kafka_source, log_source, progress_frame, query_starters, supervise
from wattline.streaming.sinks import create_sql, ensure_table, kafka_write_options, log_writer

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    """Raw readings of six buildings on two sites, prepared and written."""
    top = str(tmp_path_factory.mktemp("prepared"))
    train = spark.createDataFrame([(b, m, T0 + timedelta(hours=h), float((b * h + m) % 7)) for b in range(6) for m in (0, 2) for h in range(30)], "building_id int, meter int, timestamp timestamp, meter_reading double")
    metadata = spark.createDataFrame([(s, b, "Office", 100 + b, 1990, None) for b in range(8) for s in [b % 2 + 2]], "site_id int, building_id int, primary_use string, square_feet int, year_built int, floor_count int")
    return write_prepared(*prepare(train, metadata, [2, 3], METER_CODES), top)


@pytest.fixture
def payloads(spark, prepared, tmp_path):
    """All events as JSON lines in slices of ten minutes of replay, and some that are no events."""
    events = spark.read.parquet(prepared["telemetry"])
    sent = replay(events, str(tmp_path / "payloads"), speedup=3600.0, connections=2, slice_s=10.0, paced=False)
    assert sent["events"] == events.count() == 360 and sent["slices"] >= 3
    spark.createDataFrame([('{"building_id": 5}',), ("no json",), ("",)], "value string").coalesce(1).write.text(str(tmp_path / "payloads" / "bad"))
    return str(tmp_path / "payloads")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_from_payloads_to_the_report(spark, prepared, payloads, tmp_path, caplog):
    log, dead, ck = (str(tmp_path / x) for x in ("log", "dead", "ck"))
    totals = run_ingest(spark, payloads, log, dead, f"{ck}/ingest", avro_schema(), 1)
    assert (totals.received, totals.published, totals.rejected, totals.lost) == (363, 360, 3, 0)
    assert sum(totals.reasons.values()) == 3 and totals.reasons["not a JSON object"] == 2
    letters = [json.loads(r["value"]) for r in read_log(spark, dead).collect()]
    assert sorted(x["original_payload"] for x in letters) == ["", "no json", '{"building_id": 5}']
    frame = read_log(spark, log)
    assert log_depth(frame).first()["depth"] == frame.select("partition", "offset").distinct().count() == 360 and frame.groupBy("key").agg(F.count_distinct("partition").alias("n")).where("n > 1").isEmpty()
    # The same payloads once more from the start: the same log, nothing twice.
    run_ingest(spark, payloads, log, dead, f"{ck}/again", avro_schema(), 1)
    assert read_log(spark, log).count() == LogFolder(log).last().records == 360

    tables = Tables.at(spark, str(tmp_path / "tables"))
    tables.create()
    buildings, baseline = spark.read.parquet(prepared["buildings"]), spark.read.parquet(prepared["baseline"])
    for _ in range(2):
        load_references(tables, buildings, baseline)
    assert tables.buildings.read().count() == buildings.count() and not tables.events.create()
    options = JobOptions(trigger=None, checkpoint_dir=f"{ck}/job", run_id="r1", max_per_trigger=100, supervise_every_s=0.2)
    assert run_job(spark, log_source(spark, log, options), tables, avro_schema(), 1, options, lag=lambda at: records_behind(log, at)) == 0
    assert tables.events.read().count() == 360
    progress = tables.progress.read()
    assert {r["query_name"] for r in progress.collect()} == {"metrics", "events"} and progress.agg(F.sum("num_input_rows")).first()[0] == 720
    behind = [r["offsets_behind"] for r in progress.orderBy("query_name", "batch_id").collect()]
    assert max(behind) > 0 and behind[-1] == 0
    # All windows that are closed, with all of their events.
    closed = tables.metrics.read().drop("ingested_at", "distinct_buildings")
    want = closed_windows(expected_metrics(tables), F.lit(T0 + timedelta(hours=29))).select(closed.columns)
    assert closed.count() > 20 and rows_of(closed) == rows_of(want)
    values = measured(tables.events.read(), tables.metrics.read(), progress, valid=360, rejected=3, published=360)
    assert values["loss_pct"] == 0 and values["latency_p95_s"] > 0 and 99 < values["valid_pct"] < 100 and values["batch_p95_ms"] > 0
    text = report(values)
    assert all(name in text for name in TARGETS) and "not measured" in text
    assert set(panel_times(tables.metrics.read(), View(), repeats=1)) == set(PANELS)


def test_a_killed_query_restarts_and_loses_nothing(spark, prepared, payloads, tmp_path):
    """Both queries are broken in the middle of a batch, between data and commit; the tables end up as of an unbroken run."""
    log, dead = str(tmp_path / "log"), str(tmp_path / "dead")
    run_ingest(spark, payloads, log, dead, str(tmp_path / "ck0"), avro_schema(), 1)
    done = []
    for run in ("whole", "broken"):
        tables = Tables.at(spark, str(tmp_path / run))
        tables.create()
        load_references(tables, spark.read.parquet(prepared["buildings"]), spark.read.parquet(prepared["baseline"]))
        if run == "broken":
            for table in (tables.events, tables.metrics):
                commit, calls = table._commit, []

                def fails(manifest, commit=commit, calls=calls):
                    calls.append(1)
                    if len(calls) == 2:
                        raise RuntimeError("killed before the commit")
                    commit(manifest)
                    if len(calls) == 3:
                        raise RuntimeError("killed after the commit")

                table._commit = fails
        options = JobOptions(trigger=None, checkpoint_dir=str(tmp_path / f"ck_{run}"), max_restarts=4, supervise_every_s=0.1, max_per_trigger=100)
        assert run_job(spark, log_source(spark, log, options), tables, avro_schema(), 1, options) == 0
        done.append(tables)
    assert same_tables(*done) == {"events": 0, "metrics": 0} and done[1].events.read().count() == 360
    assert all(main(["compare", str(tmp_path / a), str(tmp_path / b)]) == 0 for a, b in (("whole", "broken"), ("broken", "whole")))


def test_a_stopped_query_is_started_again(spark, prepared, payloads, tmp_path):
    """With a processing-time trigger, a query that is stopped from outside comes back; the stop event ends the job."""
    log = str(tmp_path / "log")
    run_ingest(spark, payloads, log, str(tmp_path / "dead"), str(tmp_path / "ck0"), avro_schema(), 1)
    seen, stop = [], threading.Event()
    options = JobOptions(trigger="200 milliseconds", sink="events", checkpoint_dir=str(tmp_path / "ck"), supervise_every_s=0.2)
    events = wire.decode_events(log_source(spark, log, options)("events"), avro_schema(), 1)
    starters = query_starters(events, spark.read.parquet(prepared["buildings"]), spark.read.parquet(prepared["baseline"]), {"events": lambda df, n: seen.append(df.count())}, options)
    assert list(starters) == ["events"]
    started = []

    def start():
        started.append(starters["events"]())
        return started[-1]

    def tick():
        if sum(seen) == 360 and len(started) == 1:
            started[0].stop()
        elif len(started) == 2:
            stop.set()

    thread = threading.Timer(90, stop.set)
    thread.start()
    assert supervise({"events": start}, options, stop, on_tick=tick) == 0
    thread.cancel()
    assert len(started) == 2 and sum(seen) == 360 and not spark.streams.active
    assert list(query_starters(events, spark.read.parquet(prepared["buildings"]), spark.read.parquet(prepared["baseline"]), {"metrics": None}, JobOptions(sink="metrics"))) == ["metrics"]


def test_collisions_and_late_rows_are_reported(spark, tmp_path):
    """Two readings of one key in a batch reach the hook; rows behind the watermark are counted."""
    rows = [("1", "steam", T0 + timedelta(hours=h), 1.0, T0) for h in range(8)]
    parts = [rows[:3] + [("1", "steam", T0, 2.0, T0)], rows[6:], rows[7:], [("2", "steam", T0, 1.0, T0)]]
    for i, part in enumerate(parts):
        coded = wire.encode_events(spark.createDataFrame(part, "building_id string, meter_type string, timestamp timestamp, meter_reading double, sim_publish_ts timestamp"), avro_schema(), 1)
        append_log(coded.select(F.lit("k").alias("key"), F.lit(0).alias("partition"), "timestamp", "value"), str(tmp_path / "log"), 1)
    tables = Tables.at(spark, str(tmp_path / "tables"))
    tables.create()
    load_references(tables, spark.createDataFrame([("1", 1, "Office", 1, 1, 1), ("2", 1, "Office", 1, 1, 1)], "building_id string, site_id int, primary_use string, square_feet int, year_built int, floor_count int"), spark.createDataFrame([], "building_id string, meter_type string, baseline_p25 double, baseline_p50 double, baseline_p75 double, baseline_iqr double"))
    found = []
    options = JobOptions(trigger=None, checkpoint_dir=str(tmp_path / "ck"), max_per_trigger=1, supervise_every_s=0.2)
    assert run_job(spark, log_source(spark, str(tmp_path / "log"), options), tables, avro_schema(), 1, options, on_collision=lambda x: found.extend(x.collect())) == 0
    assert [(r["building_id"], r["copies"], r["variants"]) for r in found] == [("1", 2, 2)]
    late = {r["query_name"]: r["n"] for r in tables.progress.read().groupBy("query_name").agg(F.sum("rows_dropped_by_watermark").alias("n")).collect()}
    assert late["metrics"] == 1 and late["events"] is None


def test_ddl_twice(tmp_path):
    path = str(tmp_path / "x.db")
    for _ in range(2):
        ensure_table(lambda: sqlite3.connect(path), "progress", PROGRESS, ["trigger_ts", "run_id"], [["query_name"]])
    with sqlite3.connect(path) as db:
        assert [r[1] for r in db.execute("pragma table_info(progress)")] == PROGRESS.fieldNames()
        assert [r[0] for r in db.execute("select name from sqlite_master where type = 'index' and name like 'progress%'")] == ["progress_query_name"]
    assert create_sql("t", PROGRESS, ["run_id"])[0].startswith("create table if not exists t (trigger_ts timestamp")


def test_kafka_options(spark, monkeypatch):
    """The source stops rather than skips lost data and is bounded a trigger; the sink waits for all replicas."""
    options = JobOptions(starting_offsets="latest", max_per_trigger=7)
    want = {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": "7"}
    assert kafka_options("h:1", "t", options) == want and kafka_options("h:1", "t", JobOptions(fail_on_data_loss=False))["failOnDataLoss"] == "false"
    taken = {}
    from pyspark.sql.streaming import DataStreamReader

    monkeypatch.setattr(DataStreamReader, "format", lambda self, kind: taken.update(format=kind) or self)
    monkeypatch.setattr(DataStreamReader, "options", lambda self, **x: taken.update(x) or self)
    monkeypatch.setattr(DataStreamReader, "load", lambda self: spark.createDataFrame([(b"k", 0, 1, b"v")], "key binary, partition int, offset long, value binary"))
    assert kafka_source(spark, "h:1", "t", options).first().asDict() == {"key": "k", "partition": 0, "offset": 1, "value": bytearray(b"v")} and taken == {"format": "kafka"} | want
    assert kafka_write_options("h:1", "t")["kafka.acks"] == "all"


def test_ingest_totals_and_replayed_batches(spark, tmp_path):
    """A batch that comes twice leaves one copy in the log and in the dead letters."""
    totals = IngestTotals()
    write = ingest_writer(log_writer(str(tmp_path / "log")), log_writer(str(tmp_path / "dead")), avro_schema(), 1, totals, now=F.lit("2024-01-02"))
    good = json.dumps({"building_id": "1", "meter_type": "steam", "timestamp": "2024-01-01T00:00:00", "meter_reading": 1.5, "sim_publish_ts": 1})
    batch = spark.createDataFrame([(good,), (good.replace("2024", "2034"),), (None,)], "payload string")
    for _ in range(2):
        write(batch, 4)
    assert read_log(spark, str(tmp_path / "log")).count() == 1 and read_log(spark, str(tmp_path / "dead")).count() == 2
    assert (totals.received, totals.published, totals.rejected) == (6, 2, 4)


def test_drop_counter():
    says = iter([10, 12, 12, 3, None, 4])
    counter = DropCounter(lambda: next(says))
    assert [counter.delta() for _ in range(5)] == [2, 2, 5, None, 6]


def test_recorded_reports_equal_parsed_ones(spark, tmp_path):
    kept, rows = [], []
    recorder = ProgressRecorder("r", rows.extend)
    plain = recorder.onQueryProgress
    recorder.onQueryProgress = lambda event: (kept.append(("r", event.progress.json)), plain(event))
    spark.streams.addListener(recorder)
    spark.range(10).write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("q").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    time.sleep(1.5)
    spark.streams.removeListener(recorder)
    assert recorder.flush() == len(kept) > 0
    parsed = progress_of(spark.createDataFrame(kept, "run_id string, report string")).select(*PROGRESS.fieldNames())
    # Spark's JSON rounds rates to one decimal.
    rounded = lambda df: rows_of(df.withColumns({c: F.round(c, 1) for c in ("input_rows_per_second", "processed_rows_per_second")}))
    assert rounded(parsed) == rounded(progress_frame(spark, rows))


def test_replay_keeps_pace_and_order(spark, prepared, tmp_path):
    now = [0.0]
    out = replay(spark.read.parquet(prepared["telemetry"]), str(tmp_path / "out"), speedup=3600.0, connections=2, sensors=4, limit=60, slice_s=5.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert out["events"] == 60 and out["worst_lag_s"] <= 0 and out["seconds"] >= 10
    lines = [json.loads(x) for d in sorted(os.listdir(tmp_path / "out")) for f in sorted(os.listdir(tmp_path / "out" / d)) if f.startswith("part-") for x in (tmp_path / "out" / d / f).read_text().splitlines()]
    for sensor in {(x["building_id"], x["meter_type"]) for x in lines}:
        times = [x["timestamp"] for x in lines if (x["building_id"], x["meter_type"]) == sensor]
        assert times == sorted(times)


def test_replay_gives_up_when_it_is_too_late(spark, prepared, tmp_path):
    """A clock that runs away: the replay ends once a slice is later than allowed."""
    now = [0.0]

    def clock():
        now[0] += 20.0
        return now[0]

    with pytest.raises(RuntimeError, match="late, more than 30 s"):
        replay(spark.read.parquet(prepared["telemetry"]), str(tmp_path / "out"), speedup=3600.0, sensors=2, limit=40, slice_s=5.0, max_lag_s=30.0, clock=clock, sleep=lambda s: None)


def test_poison_does_not_stop_the_windows(spark, prepared, payloads, tmp_path):
    poison(spark, payloads, 10, "bad/ahead")
    totals = run_ingest(spark, payloads, str(tmp_path / "log"), str(tmp_path / "dead"), str(tmp_path / "ck"), avro_schema(), 1)
    assert totals.published == 360 and any("future" in k for k in totals.reasons)


def test_ladder(spark, prepared, tmp_path):
    read = lambda x: spark.read.parquet(prepared[x])
    rungs = ladder(spark, read("telemetry"), read("buildings"), read("baseline"), str(tmp_path), [2], 40).collect()
    assert [r["label"] for r in rungs] == ["2 sensors", "2 sensors (hot)"] and all(r["published_rate"] > 0 and r["latency_p95_s"] > 0 for r in rungs)


def test_reset_of_everything(spark, tmp_path):
    tables = Tables.at(spark, str(tmp_path / "t"))
    tables.create()
    (tmp_path / "log").mkdir()
    dropped = []
    reset_state(spark, str(tmp_path / "ck"), [tables.events], [tables.buildings], everything=True, logs=[str(tmp_path / "log")], drop_topic=dropped.append, topics=["events"])
    assert dropped == ["events"] and not (tmp_path / "log").exists() and not tables.events.commits() and not tables.buildings.commits() and tables.metrics.commits()
    with pytest.raises(ValueError):
        reset_state(spark, str(tmp_path / "ck"), [], topics=["events"])


def test_command_line(spark, prepared, payloads, tmp_path, capsys):
    """Every command parses; the way from registration to the report runs."""
    helped = parser().format_help()
    assert all(c in helped for c in ("prepare", "excel", "register", "simulate", "ingest", "stream", "report", "ladder", "poison", "compare", "failover", "reset"))
    at = {x: str(tmp_path / x) for x in ("catalog.json", "log", "dead", "tables", "ck")}
    assert main(["register", at["catalog.json"]]) == 0 and json.loads(capsys.readouterr().out) == {"id": 1, "new": True}
    assert main(["register", at["catalog.json"]]) == 0 and json.loads(capsys.readouterr().out) == {"id": 1, "new": False}
    assert main(["ingest", payloads, at["log"], at["dead"], "--catalog", at["catalog.json"], "--checkpoint", at["ck"] + "/i"]) == 0
    assert json.loads(capsys.readouterr().out)["published"] == 360
    assert main(["stream", at["log"], at["tables"], "--catalog", at["catalog.json"], "--dimension", prepared["buildings"], "--baseline", prepared["baseline"], "--checkpoint", at["ck"] + "/s", "--once", "--supervise-every", "0.2", "--progress-every", "1", "--rollups", "--database", f"sqlite3:{tmp_path}/x.db"]) == 0
    capsys.readouterr()
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert db.execute("select count(*) from events").fetchone()[0] == 360 and db.execute("select count(*) from metrics").fetchone()[0] > 20
    tables = Tables.at(spark, at["tables"])
    days = Rollups(spark, f"{at['tables']}/rollups", tables.metrics).read("day")
    assert days.agg(F.sum("windows"), F.sum("event_count")).first() == tables.metrics.read().agg(F.count("*"), F.sum("event_count")).first()
    assert main(["report", at["tables"], "--published", "360", "--valid", "360", "--rejected", "0", "--panels", "--rollups", "--from", "2024-01-01 00:00:00", "--to", "2024-01-02 00:00:00"]) == 0
    assert "| loss_pct | 0 |" in capsys.readouterr().out
    assert main(["failover", at["log"], str(tmp_path / "again"), "--catalog", at["catalog.json"], "--checkpoint", at["ck"] + "/f", "--max-per-trigger", "100", "--seconds", "90"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["restarts"] == 2 and found["events_lost"] == found["metrics_differ"] == 0 and 0 < found["recovery_s"] < 60
    assert main(["reset", at["tables"], "--checkpoint", at["ck"], "--logs", at["log"], "--everything"]) == 0 and not os.path.exists(at["log"])


