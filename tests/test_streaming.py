"""Streams: equal to batches on closed windows, safe against poison, restartable, observed."""

import time
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wattline.functions import wire
from wattline.operators.enrich import enrich
from wattline.operators.metrics import closed_windows, windowed_metrics
from wattline.schemas import EVENT_KEY, METRIC_KEY, PROGRESS, PROGRESS_KEY, avro_schema
from wattline.sources.log import append_log
from wattline.streaming.reset import reset_state
from wattline.streaming.runtime import Invariants, JobOptions, OrphanWatch, ProgressRecorder, log_source, progress_frame, query_starters, supervise
from wattline.streaming.sinks import KeyedTable, upsert_writer

T0 = datetime(2024, 1, 1)
EVENTS = "building_id string, meter_type string, timestamp timestamp, meter_reading double, sim_publish_ts timestamp"


@pytest.fixture(scope="module")
def reference(spark):
    buildings = spark.createDataFrame([(str(b), b % 2, "Office", 100.0) for b in range(4)], "building_id string, site_id int, primary_use string, square_feet double")
    baseline = spark.createDataFrame([(str(b), "steam", 5.0, 1.0) for b in range(4)], "building_id string, meter_type string, baseline_p75 double, baseline_iqr double")
    return buildings, baseline


def events(hours, poison=False):
    rows = [(str(b), "steam", T0 + timedelta(hours=h, minutes=b), float((h * b) % 13), T0 + timedelta(hours=h)) for h in hours for b in range(5)]
    return rows + ([("1", "steam", T0 + timedelta(days=36500), 1.0, T0)] if poison else [])


def write_log(spark, path, parts):
    """Each part becomes a commit of framed records."""
    for rows in parts:
        coded = wire.encode_events(spark.createDataFrame(rows, EVENTS), avro_schema(), 3)
        append_log(coded.select(F.concat_ws(":", "building_id", "meter_type").alias("key"), F.lit(0).alias("partition"), "timestamp", "value"), path, 2)


def stream(spark, path, query="q", checkpoint="ck"):
    options = JobOptions(checkpoint_dir=checkpoint, max_per_trigger=1)
    return wire.decode_events(log_source(spark, path, options)(query), avro_schema(), 3)


def table(spark, path, schema, keys, order):
    return KeyedTable(spark, path, schema, keys, order)


def test_job_equals_batch_and_replay_is_harmless(spark, reference, tmp_path):
    parts = [events(range(0, 4)), events(range(4, 8)), events(range(8, 12))]
    write_log(spark, str(tmp_path / "log"), parts)
    options = JobOptions(trigger=None, checkpoint_dir=str(tmp_path / "ck"))
    live = lambda query: stream(spark, str(tmp_path / "log"), query, options.checkpoint_dir)
    batch = spark.createDataFrame([r for p in parts for r in p], EVENTS)
    metrics = windowed_metrics(enrich(batch, *reference))
    stores = {"metrics": table(spark, str(tmp_path / "m"), metrics.schema, METRIC_KEY, ["max_sim_publish_ts"]), "events": table(spark, str(tmp_path / "e"), "building_id string, meter_type string, event_time timestamp, meter_reading double, sim_publish_ts timestamp", ["building_id", "meter_type", "event_time"], ["sim_publish_ts"])}
    stores["events"].schema = batch.withColumnRenamed("timestamp", "event_time").schema
    recorder_rows = []
    recorder = ProgressRecorder("run", recorder_rows.extend)
    spark.streams.addListener(recorder)
    starters = query_starters(live, *reference, {k: upsert_writer(s) for k, s in stores.items()}, options)
    assert supervise(starters, options, sleep=lambda s: time.sleep(0.2)) == 0
    last = F.lit(max(r[2] for p in parts for r in p))
    want = closed_windows(metrics, last)
    shown = [c for c in metrics.columns if c != "distinct_buildings"]
    assert sorted(map(str, stores["metrics"].read().select(shown).collect())) == sorted(map(str, want.select(shown).collect()))
    assert stores["events"].read().count() == batch.count()
    time.sleep(1)
    spark.streams.removeListener(recorder)
    assert recorder.flush() > 0 and {r["query_name"] for r in recorder_rows} == {"metrics", "events"}
    frame = progress_frame(spark, recorder_rows)
    assert frame.schema == PROGRESS and frame.select(*PROGRESS_KEY).distinct().count() == frame.count()
    # The same log once more, from new checkpoints: nothing changes.
    again = JobOptions(trigger=None, checkpoint_dir=str(tmp_path / "ck2"))
    before = sorted(map(str, stores["metrics"].read().select(shown).collect()))
    supervise(query_starters(lambda query: stream(spark, str(tmp_path / "log"), query, again.checkpoint_dir), *reference, {k: upsert_writer(s) for k, s in stores.items()}, again), again, sleep=lambda s: time.sleep(0.2))
    assert sorted(map(str, stores["metrics"].read().select(shown).collect())) == before and stores["events"].read().count() == batch.count()
    reset_state(spark, str(tmp_path / "ck"), list(stores.values()))
    assert not (tmp_path / "ck").exists() and stores["metrics"].read().count() == 0


@pytest.mark.parametrize("margin, late", [(300.0, True), (None, False)])
def test_poisoned_watermark(spark, reference, tmp_path, margin, late):
    """One event from far ahead: guarded, later hours still arrive; unguarded, they are dropped."""
    write_log(spark, str(tmp_path / "log"), [events(range(0, 3)), events(range(3, 6), poison=True), events(range(6, 9)), events(range(9, 12))])
    live = enrich(stream(spark, str(tmp_path / "log")), *reference)
    name = f"poison_{int(late)}"
    query = windowed_metrics(live, margin_s=margin).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    hours = {r["window_start"].hour for r in spark.table(name).collect() if r["window_start"].year == 2024}
    # The watermark of one batch holds from the next but one, so the last batch tells.
    assert {0, 1, 2} <= hours and bool(hours & {9, 10, 11}) == late


def test_wrong_schema_stops_the_query(spark, tmp_path):
    write_log(spark, str(tmp_path / "log"), [events([0])])
    live = wire.decode_events(log_source(spark, str(tmp_path / "log"))("q"), avro_schema(), 4)
    query = live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    with pytest.raises(Exception, match="schema 3, this query reads schema 4"):
        query.awaitTermination(60)


class Fake:
    def __init__(self, lives):
        self.lives = lives
        self.stopped = False

    @property
    def isActive(self):
        self.lives -= 1
        return self.lives > 0

    def exception(self):
        return RuntimeError("lost") if self.lives <= 0 and not self.stopped else None

    def stop(self):
        self.stopped = True


def test_supervisor():
    options = JobOptions(max_restarts=3)
    started = {"a": 0, "b": 0}

    def start(name, lives):
        def go():
            started[name] += 1
            return Fake(lives)

        return go

    assert supervise({"a": start("a", 1)}, options, sleep=lambda s: None) == 1 and started["a"] == 4
    fine = Fake(3)
    fine.exception = lambda: None
    assert supervise({"b": lambda: fine}, JobOptions(trigger=None), sleep=lambda s: None) == 0
    stopped = Fake(1)
    stopped.exception = lambda: None
    ticks = []
    assert supervise({"b": lambda: stopped}, options, sleep=lambda s: None, on_tick=lambda: ticks.append(1)) == 1 and ticks  # stopped from outside: restarted, then given up
    calls = []

    def once():
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("no checkpoint")
        return Fake(1)

    assert supervise({"c": once}, options, sleep=lambda s: None) == 1 and len(calls) == 2
    with pytest.raises(ValueError):
        JobOptions(sink="none")


def test_invariants_and_recorder():
    row = {"query_name": "q", "offsets_behind": 5000, "num_input_rows": 0, "rows_dropped_by_watermark": 0}
    seen = Invariants()
    assert [len(seen.check(row)) for _ in range(4)] == [0, 0, 1, 1]
    assert seen.check(row | {"num_input_rows": 1}) == [] and seen.check(row) == []
    assert [len(Invariants.check(seen, row | {"num_input_rows": 1, "rows_dropped_by_watermark": n})) for n in (5, 5, 4, 6)] == [1, 0, 0, 1]
    fail = [True]

    def write(rows):
        if fail[0]:
            raise OSError("down")

    recorder = ProgressRecorder("r", write)
    recorder.pending = [row]
    assert recorder.flush() == 0 and recorder.pending == [row]
    fail[0] = False
    assert recorder.flush() == 1 and recorder.pending == []


def test_orphan_watch(spark):
    warned, known = [], spark.createDataFrame([("1",)], "building_id string")
    now = SimpleNamespace(rows=[("1",), ("2",)])
    watch = OrphanWatch(lambda: spark.createDataFrame(now.rows, "building_id string"), lambda: known, every=2, warn=warned.append)
    for n in range(5):
        watch.tick()
        if n == 2:
            now.rows.append(("3",))
    assert warned == ["1 events of 1 unknown buildings", "2 events of 2 unknown buildings"]


def test_event_key():
    assert EVENT_KEY == ["building_id", "meter_type", "timestamp"]
