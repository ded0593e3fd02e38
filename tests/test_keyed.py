"""Keyed tables that are merged on reading: crashes, what a batch writes, compaction, readers of old versions."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wattline.streaming.sinks import KeyedTable, Run

T0 = datetime(2024, 1, 1)
SCHEMA = "k int, at timestamp, v int"


def made(spark, path, **settings):
    return KeyedTable(spark, str(path), SCHEMA, ["k", "at"], ["v"], "at", **settings)


def batch(spark, *rows):
    return spark.createDataFrame([(k, None if d is None else T0 + timedelta(days=d), v) for k, d, v in rows], SCHEMA)


def held(table):
    return sorted(((r["k"], None if r["at"] is None else (r["at"] - T0).days, r["v"]) for r in table.read().collect()), key=str)


@pytest.mark.parametrize("step", ["write", "before", "after", "vacuum"])
def test_a_crash_at_any_step(spark, tmp_path, step, monkeypatch):
    """The last commit stands; the same batch again gives what an unbroken run would have given."""
    table = made(spark, tmp_path / "t", keep=2, fan=3)
    for v in range(4):
        table.upsert(batch(spark, (1, 0, v), (2, 1, v), (3, None, v)))
    before = held(table)

    def fail(*args, **more):
        raise RuntimeError("no power")

    commit = table._commit
    if step == "write":
        monkeypatch.setattr(table, "_write", fail)
    elif step == "before":
        monkeypatch.setattr(table, "_commit", fail)
    elif step == "after":
        monkeypatch.setattr(table, "_commit", lambda changes: (commit(changes), fail()))
    else:
        monkeypatch.setattr(table, "_vacuum", fail)
    with pytest.raises(RuntimeError, match="no power"):
        table.upsert(batch(spark, (1, 0, 9), (4, 0, 9)))
    (tmp_path / "t" / "_commits" / "left.draft").write_text("{")
    again = made(spark, tmp_path / "t", keep=2, fan=3)
    after = [(1, 0, 9), (2, 1, 3), (3, None, 3), (4, 0, 9)]
    assert held(again) == (before if step in ("write", "before") else after)
    again.upsert(batch(spark, (1, 0, 9), (4, 0, 9)))
    assert held(again) == after


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    """Bytes written follow the batch, not the table; untouched days keep their runs; readers of older versions go on."""

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet"))

    table = made(spark, tmp_path / "t")
    table.upsert(spark.range(60_000).selectExpr("cast(id as int) as k", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 3 as int)) as at", "cast(hash(id) as int) as v"))
    whole, first, reader = size(), table.manifest(), table.read()
    for v in range(3):
        before = size()
        table.upsert(batch(spark, (0, 0, v), (70_000 + v, 0, v)))
        assert size() - before < whole / 50
    assert table.manifest()["2024-01-02"] == first["2024-01-02"] and len(table.manifest()["2024-01-01"]) == 4
    assert reader.count() == 60_000 and table.read().count() == 60_003
    assert table.read().where("k = 0").first()["v"] == 2


def test_random_merges_equal_a_dictionary(spark, tmp_path):
    """Upserts and inserts that ignore, in any order, through compactions of all sizes."""
    rng = random.Random(3)
    table, want = made(spark, tmp_path / "t", keep=3, fan=2), {}
    for n in range(24):
        rows = [(rng.randrange(12), rng.choice([0, 0, 1, 2, None]), 100 * n + i) for i in range(rng.choice([1, 3, 9]))]
        if rng.random() < 0.4:
            for k, d, v in rows:
                want.setdefault((k, d), v)
            table.insert_ignore(batch(spark, *rows))
        else:
            want.update({(k, d): v for k, d, v in rows})
            table.upsert(batch(spark, *rows))
        if n % 4 == 3:
            assert held(table) == sorted(((k, d, v) for (k, d), v in want.items()), key=str), n
    assert len(table.commits()) <= 2 * 3 + KeyedTable.FULL_EVERY
    again = made(spark, tmp_path / "t")
    assert held(again) == sorted(((k, d, v) for (k, d), v in want.items()), key=str)
    used = {r.folder.split("/")[1] for n in again.commits()[-3:] for runs in again.manifest(n).values() for r in runs}
    assert used <= set(os.listdir(tmp_path / "t" / "data"))


def test_runs_that_do_not_meet_are_not_merged(spark, tmp_path):
    table = made(spark, tmp_path / "t")
    hour = lambda h, v: spark.createDataFrame([(1, T0 + timedelta(hours=h), v)], SCHEMA)
    for h in range(4):
        table.upsert(hour(h, h))
    assert "Exchange" not in table.read()._jdf.queryExecution().toString() and table.read().count() == 4
    table.upsert(hour(2, 9))
    assert sorted((r["at"].hour, r["v"]) for r in table.read().collect()) == [(0, 0), (1, 1), (2, 9), (3, 3)]


def test_write_amplification_is_logarithmic(spark):
    """Size tiers: rows are rewritten once a tier."""
    table = KeyedTable(spark, "unused", SCHEMA, ["k"], ["v"], fan=4)
    runs, written = [], 0
    for n in range(256):
        runs.append(Run(f"data/{n}", n, 10))
        at = table._span(runs)
        if at < len(runs) - 1:
            rows = sum(r.rows for r in runs[at:])
            runs[at:], written = [Run("data/x", n, rows)], written + rows
        assert len(runs) <= 4 * 5
    assert written <= 2560 * 5 and sum(r.rows for r in runs) == 2560


def test_pins_keep_a_version(spark, tmp_path):
    table = made(spark, tmp_path / "t", keep=2)
    table.upsert(batch(spark, (1, 0, 1)))
    with table.pinned() as commit:
        old = table.read(commit)
        for v in range(20):
            table.upsert(batch(spark, (1, 0, v)))
        assert [r["v"] for r in old.collect()] == [1]
    for v in range(8):
        table.upsert(batch(spark, (1, 0, v)))
    assert not os.listdir(tmp_path / "t" / "_pins") or all(not n.endswith(".pin") for n in os.listdir(tmp_path / "t" / "_pins"))
    assert held(table) == [(1, 0, 7)]


def most_memory_of_a_task(spark, action):
    """The largest mean over a stage's tasks, of the stages that ``action`` runs."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    listed = lambda: {(x := found.apply(i)).stageId(): x.peakExecutionMemory() / max(1, x.numTasks()) for found in [stages()] for i in range(found.size())}
    before = set(listed())
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(m for stage, m in listed().items() if stage not in before)


def test_a_task_does_not_gather_the_sorts_of_all_partitions(spark, tmp_path):
    """As in a batch of a query with state: as many partitions as it has, not joined at run time."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("v"))
    used = {}
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            table = KeyedTable(spark, str(tmp_path / f"t{n}"), "k string, ts timestamp, v double", ["k"], ["v"], "ts")
            table.create()
            used[n] = most_memory_of_a_task(spark, lambda table=table: table.upsert(rows))
            assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert used[40] <= 2 * used[4]
