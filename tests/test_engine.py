"""Operators on hand-made rows, and properties."""

import sqlite3
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattline.functions.anomaly import is_anomaly
from wattline.operators import dedup, enrich, metrics, prepare, replay
from wattline.plans import kpi
from wattline.schemas import EVENT_KEY, SENSOR_KEY
from wattline.sources.readers import MissingTable, load_reference, read_any
from wattline.streaming.sinks import dbapi_writer, upsert_sql, with_retries

T0 = datetime(2024, 1, 1)
EVENTS = "building_id string, meter_type string, timestamp timestamp, meter_reading double, sim_publish_ts timestamp"


def event(building="1", meter="steam", hours=0.0, reading=1.0, sent=0):
    return (building, meter, T0 + timedelta(hours=hours), reading, T0 + timedelta(seconds=sent))


def test_anomaly_rule(spark):
    rows = [(60.0, 10.0, 10.0, False), (60.1, 10.0, 10.0, True), (99.0, 10.0, 0.0, False), (99.0, None, None, False), (None, 10.0, 10.0, None)]
    df = spark.createDataFrame(rows, "r double, p75 double, iqr double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", is_anomaly(F.col("r"), F.col("p75"), F.col("iqr"))).collect())


def test_metrics_drop_orphans_and_the_future(spark):
    events = spark.createDataFrame([event(), event(hours=0.5, reading=0.0), event("9"), event(hours=24 * 400)], EVENTS)
    buildings = spark.createDataFrame([("1", 2, "Office", 50.0), ("2", 2, "Office", 0.0)], "building_id string, site_id int, primary_use string, square_feet double")
    baseline = spark.createDataFrame([("1", "steam", 0.0, 0.0)], "building_id string, meter_type string, baseline_p75 double, baseline_iqr double")
    out = metrics.windowed_metrics(enrich.enrich(events, buildings, baseline), now=F.lit("2024-01-02")).collect()
    assert len(out) == 1
    assert (out[0]["event_count"], out[0]["zero_count"], out[0]["anomaly_count"], out[0]["avg_energy_intensity"]) == (2, 1, 0, 0.01)
    assert metrics.raw_events(events).count() == 4 and metrics.raw_events(events).columns[2] == "event_time"
    assert enrich.orphan_summary(events, buildings).first() == (1, 1)


def test_margin_is_inclusive(spark):
    rows = [(T0 + timedelta(seconds=s),) for s in (300, 301)] + [(None,)]
    assert metrics.not_future(spark.createDataFrame(rows, "timestamp timestamp"), now=F.lit(T0)).count() == 1


def test_last_wins_and_collisions(spark):
    rows = [event(sent=1), event(sent=2), event("2", reading=float("nan")), event("2", reading=float("nan"), sent=3), event("3", reading=1.0), event("3", reading=2.0, sent=5)]
    df = spark.createDataFrame(rows, EVENTS)
    last = {r["building_id"]: r for r in dedup.dedup_last(df, EVENT_KEY, ["sim_publish_ts"]).collect()}
    assert last["1"]["sim_publish_ts"] == T0 + timedelta(seconds=2) and last["3"]["meter_reading"] == 2.0 and len(last) == 3
    assert [r["building_id"] for r in dedup.key_collisions(df, EVENT_KEY).collect()] == ["3"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.integers(0, 50)), min_size=1, max_size=12))
def test_merging_twice_is_merging_once(spark, rows):
    df = spark.createDataFrame([(k, v, n) for k, v, n in rows], "k string, v int, n int")
    once = dedup.upsert_merge(df.limit(0), df, ["k"], ["n"])
    twice = dedup.upsert_merge(once, df, ["k"], ["n"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_insert_ignore_keeps_what_is_there(spark):
    old, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert sorted(map(tuple, dedup.insert_ignore(old, new, ["k"], ["v"]).collect())) == [("a", 1), ("b", 3)]


def test_replay(spark):
    events = spark.createDataFrame([event(str(b), hours=h) for b in (1, 10, 2) for h in (0, 1, 5)], EVENTS)
    sets = [{tuple(r) for r in replay.sensor_subset(events, n).select(*SENSOR_KEY).distinct().collect()} for n in (1, 2, 3, 99)]
    assert sets[0] < sets[1] < sets[2] == sets[3] and ("10", "steam") in sets[1] and replay.sensor_subset(events, 0).count() == 9
    moved = replay.rebase(events, F.lit("2025-06-01 00:00:00")).orderBy("timestamp").select("timestamp").distinct().collect()
    times = sorted(r[0] for r in moved)
    assert times[-1] == datetime(2025, 6, 1) and [b - a for a, b in zip(times, times[1:])] == [timedelta(hours=1), timedelta(hours=4)]
    plan = replay.replay_schedule(events, 3600.0, 2).collect()
    assert all(len({r["connection"] for r in plan if r["building_id"] == b}) == 1 for b in ("1", "10", "2"))
    assert {round(r["offset_s"], 6) for r in plan if r["building_id"] == "10"} == {round(h + 1 / 3, 6) for h in (0, 1, 5)}


def test_unknown_meter_code(spark):
    df = spark.createDataFrame([(0,), (7,)], "meter int")
    assert df.where("meter = 0").select(prepare.decode_meter(F.col("meter"))).first()[0] == "electricity"
    with pytest.raises(Exception, match="unknown meter code 7"):
        df.select(prepare.decode_meter(F.col("meter"))).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    assert read_any(spark, str(tmp_path / "a.csv"), "x int, y string").first() == (1, "b")
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path / "a.csv"))
    with pytest.raises(MissingTable, match="prepare"):
        load_reference(spark, str(tmp_path / "none"), str(tmp_path / "none"))


def test_retries_only_lost_connections():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError

    with_retries(flaky, 5, 3.0, sleep=waits.append)
    assert (len(calls), waits) == (3, [3.0, 3.0])
    with pytest.raises(ConnectionError):
        with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), 2, 0, sleep=waits.append)
    with pytest.raises(ValueError):
        with_retries(lambda: (_ for _ in ()).throw(ValueError()), 5, 0, sleep=lambda s: pytest.fail("waited"))


def test_database_upsert(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute("create table t (k text primary key, v integer, n integer)")
    write = dbapi_writer(lambda: __import__("sqlite3").connect(path, timeout=30), "t", ["k"], ["n"], page=2)
    for rows in ([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], [("a", 3, 3), ("c", 1, 1)], [("a", 3, 3), ("c", 1, 1)]):
        write(spark.createDataFrame(rows, "k string, v int, n int").coalesce(1), 0)
    with sqlite3.connect(path) as con:
        assert sorted(con.execute("select k, v from t")) == [("a", 3), ("b", 5), ("c", 1)]
    assert "do nothing" in upsert_sql("t", ["k"], ["k"])


def test_report():
    text = kpi.report({"latency_p95_s": 1.0, "rate": 10.0})
    assert "| latency_p95_s | 1 | < 2 | yes |" in text and "| rate | 10 | >= 50 | no |" in text and "not measured" in text
