"""Zero runs on a stream against those of a batch, out of order, restarted in the middle, and closed by silence."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from wattline.functions import wire
from wattline.operators.metrics import zero_runs
from wattline.schemas import avro_schema
from wattline.sources.log import append_log
from wattline.streaming.runs import _KEPT, _in_order, _joined, zero_runs_stream
from wattline.streaming.runtime import JobOptions, log_source

T0 = datetime(2024, 1, 1)
EVENTS = "building_id string, meter_type string, timestamp timestamp, meter_reading double, sim_publish_ts timestamp"


def write(spark, path, rows):
    coded = wire.encode_events(spark.createDataFrame(rows, EVENTS), avro_schema(), 1)
    append_log(coded.select(F.concat_ws(":", "building_id", "meter_type").alias("key"), F.lit(0).alias("partition"), "timestamp", "value"), path, 2)


def follow(spark, path, tmp_path, batches=None):
    options = JobOptions(checkpoint_dir=str(tmp_path / "ck"), max_per_trigger=1)
    live = wire.decode_events(log_source(spark, path, options)("runs"), avro_schema(), 1)
    out = str(tmp_path / "out")

    def keep(df, n):
        df.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={n}")
        if batches is not None:
            batches.append(n)
            if len(batches) == 3:
                raise RuntimeError("killed after its write")

    query = zero_runs_stream(live).writeStream.option("checkpointLocation", f"{options.checkpoint_dir}/runs").foreachBatch(keep).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out).drop("batch")


def shown(df):
    return sorted(map(tuple, df.select("building_id", "meter_type", "run_start", "run_end", "readings").collect()))


def test_a_stream_equals_the_batch_though_it_is_killed(spark, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "log")
    rows = [(str(b), m, T0 + timedelta(hours=h), float(rng.choice([0, 0, 0, 1, 2])), T0) for h in range(60) for b in range(4) for m in ("steam", "electricity")]
    # A reading that ends every run, and one by which the watermark passes it.
    rows += [(str(b), m, T0 + timedelta(hours=60 + h), 1.0, T0) for h in range(2) for b in range(4) for m in ("steam", "electricity")]
    for a in range(0, len(rows), 80):
        part = rows[a : a + 80]
        rng.shuffle(part)
        write(spark, path, part)
    batches = []
    try:
        follow(spark, path, tmp_path, batches)
        raise AssertionError("the query was to be killed")
    except Exception as error:
        assert "killed after its write" in str(error)
    got = follow(spark, path, tmp_path)
    want = zero_runs(spark.createDataFrame(rows, EVENTS))
    assert shown(got) == shown(want) and len(shown(want)) > 30


def test_silence_ends_a_run(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [("1", "steam", T0 + timedelta(hours=h), 0.0, T0) for h in range(3)] + [("2", "steam", T0, 0.0, T0)])
    for day in (1, 9, 9.5):
        write(spark, path, [("3", "steam", T0 + timedelta(days=day), 1.0, T0)])
    assert shown(follow(spark, path, tmp_path)) == [("1", "steam", T0, T0 + timedelta(hours=2), 3)]


def test_order():
    assert _in_order([(5, True), (1, True), (9, False), (7, False)], (0, 0, 0), 8) == ([(9, False)], (1, 5, 0), [(1, 5, 2)])
    assert _in_order([(3, True)], (1, 2, 2), 4) == ([], (1, 3, 3), [])


def test_many_sensors_share_a_state(spark, tmp_path):
    """As many steps a batch as there are buckets, however many sensors: same runs."""
    rng, path = random.Random(8), str(tmp_path / "log")
    rows = [(str(b), "steam", T0 + timedelta(hours=h), float(rng.choice([0, 0, 1])), T0) for h in range(12) for b in range(300)]
    rows += [(str(b), "steam", T0 + timedelta(hours=12 + h), 1.0, T0) for h in range(2) for b in range(300)]
    for a in range(0, len(rows), 1400):
        write(spark, path, rows[a : a + 1400])
    live, kept = wire.decode_events(log_source(spark, path, JobOptions(checkpoint_dir=str(tmp_path / "ck"), max_per_trigger=1))("runs"), avro_schema(), 1), []
    query = zero_runs_stream(live, buckets=8).writeStream.option("checkpointLocation", str(tmp_path / "ck/runs")).foreachBatch(lambda df, n: kept.extend(df.collect())).start()
    try:
        query.processAllAvailable()
        states = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    finally:
        query.stop()
    assert max(states) == 8
    assert sorted(map(tuple, kept)) == shown(zero_runs(spark.createDataFrame(rows, EVENTS)))


def test_sensors_together_are_as_each_alone():
    rng = random.Random(3)
    for _ in range(100):
        idle, horizons = rng.choice([15, 10**6]), sorted(rng.sample(range(60), 4))
        rows = [(str(rng.randrange(4)), rng.choice(["steam", "water"]), rng.randrange(60), rng.random() < 0.7) for _ in range(rng.randrange(1, 80))]
        kept, alone, got, want = pd.DataFrame(columns=_KEPT.names), {}, [], []
        for low, horizon in zip([-1, *horizons], horizons):
            new = [r for r in rows if low <= r[2] < horizon + 5]
            rows = [r for r in rows if r[2] >= horizon + 5]
            frame = pd.DataFrame([(b, m, t, t, int(z)) for b, m, t, z in new], columns=_KEPT.names)
            kept, ended, due = _joined(pd.concat([kept, frame]), horizon, idle)
            got += [(b, m, a, e, n) for b, m, a, e, n in ended.itertuples(index=False)]
            for b, m, t, z in new:
                alone.setdefault((b, m), [[], (0, 0, 0)])[0].append((t, z))
            dues = []
            for key, (pending, run) in alone.items():
                pending, run, found = _in_order(pending, run, horizon)
                if run[2] and not pending and horizon >= run[1] + idle:
                    found, run = [*found, run], (0, 0, 0)
                alone[key] = [pending, run]
                want += [(*key, *r) for r in found]
                dues += [pending[0][0] if pending else run[1] + idle] if pending or run[2] else []
            assert sorted(got) == sorted(want) and due == (min(dues) if dues else None)
