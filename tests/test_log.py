"""The log source and sink: order, offsets, positions, crashes between its two phases, code on the workers."""

import ast
import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattline.sources import log
from wattline.sources.log import LogFolder, LostOffsets, append_log, read_log, records_behind
from wattline.streaming.runtime import JobOptions, log_source

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(spark, numbers, partitions=3):
    n = spark.createDataFrame([(x,) for x in numbers], "n int").repartition(4)
    return n.select(F.concat(F.lit("k"), F.col("n") % 7).alias("key"), (F.col("n") % 7 % partitions).alias("partition"), F.timestamp_seconds("n").alias("timestamp"), F.col("n").cast("string").cast("binary").alias("value"))


def numbers(df):
    return [int(bytes(r["value"])) for r in df.orderBy("partition", "offset").collect()]


def test_offsets_are_gapless_and_in_order(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(5):
        append_log(rows(spark, range(100 * n, 100 * n + 100)), path, 3, "w", n)
    append_log(rows(spark, range(400, 500)), path, 3, "w", 4)  # a batch once more
    found = read_log(spark, path)
    assert found.dtypes == [("key", "string"), ("partition", "int"), ("offset", "bigint"), ("value", "binary")]
    for p in range(3):
        mine = found.where(F.col("partition") == p).orderBy("offset").collect()
        assert [r["offset"] for r in mine] == list(range(len(mine))) and [int(bytes(r["value"])) for r in mine] == [n for n in range(500) if n % 7 % 3 == p]
    assert LogFolder(path).last().records == 500 and LogFolder(path).last().writers == {"w": 4}
    # One partition's rows come out of several tasks, so no task gathers it.
    assert max(sum(s.partition == 0 for s in LogFolder(path).commit(n).segments) for n in range(1, 6)) > 1


def test_a_writer_that_is_killed_between_its_phases(spark, tmp_path):
    """Staged segments are no part of the log; the repeated batch leaves no gap and nothing twice."""
    path = str(tmp_path / "log")
    append_log(rows(spark, range(50)), path, 2, "w", 0)
    folder = LogFolder(path)
    staged = folder.stage(iter([pa.RecordBatch.from_pydict({"key": ["k"], "partition": pa.array([1], pa.int32()), "value": [b"999"]})]))
    assert len(staged) == 1 and read_log(spark, path).count() == 50  # killed here
    append_log(rows(spark, range(50, 80)), path, 2, "w", 1)
    assert sorted(numbers(read_log(spark, path))) == list(range(80))
    for p in range(3):
        offsets = sorted(r["offset"] for r in read_log(spark, path).where(F.col("partition") == p).collect())
        assert offsets == list(range(len(offsets)))
    # Killed after the commit: the same batch again changes nothing, and its segments go.
    again = folder.stage(iter([pa.RecordBatch.from_pydict({"key": ["k"], "partition": pa.array([1], pa.int32()), "value": [b"50"]})]))
    assert folder.append(again, "w", 1) is None and folder.last().records == 80
    before = len(os.listdir(f"{path}/data"))
    assert folder.forget(keep=10) == 0 and len(os.listdir(f"{path}/data")) == before - 1 and read_log(spark, path).count() == 80


def streamed(spark, path, tmp_path, most, collected, query="q"):
    options = JobOptions(checkpoint_dir=str(tmp_path / "ck"), max_per_trigger=most)
    live = log_source(spark, path, options)(query)
    running = live.writeStream.queryName(query).option("checkpointLocation", f"{options.checkpoint_dir}/{query}").foreachBatch(lambda df, n: collected.append(numbers(df))).start()
    try:
        running.processAllAvailable()
        return ast.literal_eval(str(running.lastProgress["sources"][0]["endOffset"]))
    finally:
        running.stop()


def test_whole_commits_in_order_and_a_restart(spark, tmp_path):
    path, batches = str(tmp_path / "log"), []
    for n in range(6):
        append_log(rows(spark, range(10 * n, 10 * n + 10)), path, 2)
    position = streamed(spark, path, tmp_path, 25, batches)
    assert [sorted(b) for b in batches] == [list(range(20)), list(range(20, 40)), list(range(40, 60))]
    assert position["records"] == 60 and records_behind(path, position) == 0
    for n in range(6, 9):
        append_log(rows(spark, range(10 * n, 10 * n + 10)), path, 2)
    assert records_behind(path, position) == 30
    batches.clear()
    streamed(spark, path, tmp_path, 10, batches)  # a new query from the old checkpoint, with another bound
    assert [sorted(b) for b in batches] == [list(range(60, 70)), list(range(70, 80)), list(range(80, 90))]


@pytest.mark.parametrize("what", ["commit", "segment"])
def test_lost_offsets_stop_the_query(spark, tmp_path, what):
    path, batches = str(tmp_path / "log"), []
    for n in range(4):
        append_log(rows(spark, range(10 * n, 10 * n + 10), 1), path, 1)
    folder = LogFolder(path)
    os.remove(folder._file(3) if what == "commit" else f"{path}/data/{folder.commit(3).segments[0].file}")
    with pytest.raises(Exception, match="gone"):
        streamed(spark, path, tmp_path, 10, batches)
    assert sum(batches, []) == list(range(20))
    with pytest.raises(Exception, match="gone"):
        read_log(spark, path).count()


def test_forgotten_commits(spark, tmp_path):
    """A new reader begins with what is there; one that has not read what went fails."""
    path, batches = str(tmp_path / "log"), []
    for n in range(3):
        append_log(rows(spark, range(10 * n, 10 * n + 10)), path, 1)
    streamed(spark, path, tmp_path, 100, batches)
    for n in range(3, 6):
        append_log(rows(spark, range(10 * n, 10 * n + 10)), path, 1)
    assert LogFolder(path).forget(keep=2) == 4
    assert sorted(numbers(read_log(spark, path))) == list(range(40, 60)) and read_log(spark, path).agg(F.min("offset")).first()[0] > 0
    with pytest.raises(Exception, match="gone"):
        streamed(spark, path, tmp_path, 100, batches)
    fresh = []
    streamed(spark, path, tmp_path, 100, fresh, query="other")
    assert sorted(sum(fresh, [])) == list(range(40, 60))


def test_gaps_are_found_in_planning(tmp_path):
    folder = LogFolder(str(tmp_path))
    stage = lambda: folder.stage(iter([pa.RecordBatch.from_pydict({"key": ["a", "b"], "value": [b"1", b"2"]})]))
    first, second = folder.append(stage()), folder.append(stage())
    assert [s.first for s in folder.between(folder.earliest(), second.position())] == [0, 2]
    with pytest.raises(LostOffsets, match="offsets 0 to 1 of partition 0"):
        folder.between({"commit": first.number, "records": 0, "next": {}}, second.position())
    assert len(folder.between({"commit": first.number, "records": 0, "next": {}}, second.position(), fail=False)) == 1


def test_a_stream_into_a_log(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        append_log(rows(spark, range(10 * n, 10 * n + 10)), source, 2)
    live = log_source(spark, source, JobOptions(checkpoint_dir=str(tmp_path), max_per_trigger=1))("copy").select("key", "partition", "value")
    query = live.writeStream.format(log.FORMAT).option("path", target).option("writer", "copy").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(numbers(read_log(spark, target))) == list(range(30)) and LogFolder(target).last().writers["copy"] == 2


def test_empty_logs(spark, tmp_path):
    assert read_log(spark, str(tmp_path / "none")).count() == 0
    batches = []
    append_log(rows(spark, []), str(tmp_path / "log"), 2, "w", 0)
    assert read_log(spark, str(tmp_path / "log")).count() == 0 and LogFolder(str(tmp_path / "log")).last().records == 0
    streamed(spark, str(tmp_path / "log"), tmp_path, 10, batches)
    assert sum(batches, []) == []


ELSEWHERE = """
import sys; sys.path.insert(0, {top!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
from wattline.functions import wire
from wattline.schemas import avro_schema
from wattline.sources.log import append_log, read_log
e = spark.sql("select 'b' as building_id, 'steam' as meter_type, timestamp'2024-01-01' as timestamp, 1.5d as meter_reading, timestamp'2024-01-01' as sim_publish_ts")
coded = wire.encode_events(e, avro_schema(), 1).select(F.lit("k").alias("key"), "value")
append_log(coded, {log!r}, 1)
print("READ", wire.decode_events(read_log(spark, {log!r}), avro_schema(), 1).first()["meter_reading"])
from wattline.streaming.runtime import JobOptions, log_source
live = wire.decode_events(log_source(spark, {log!r}, JobOptions(checkpoint_dir={log!r}))("q"), avro_schema(), 1)
query = live.writeStream.foreachBatch(lambda df, n: print("STREAMED", df.first()["meter_reading"])).option("checkpointLocation", {log!r} + "-ck").start()
query.processAllAvailable()
query.stop()
"""


def test_workers_get_the_package(tmp_path):
    """From another folder, with the package on the driver's path alone."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if os.environ.get("PYTHONPATH"):
        env["PYTHONPATH"] = os.pathsep.join(x for x in os.environ["PYTHONPATH"].split(os.pathsep) if os.path.abspath(x) != TOP)
    out = subprocess.run([sys.executable, "-c", ELSEWHERE.format(top=TOP, log=str(tmp_path / "log"))], cwd=tmp_path, capture_output=True, text=True, env=env)
    assert "READ 1.5" in out.stdout and "STREAMED 1.5" in out.stdout, out.stderr[-2000:]


def test_tasks_that_write_the_log_grow_with_the_events(spark, monkeypatch):
    from wattline.plans import queries
    from wattline.sources.fixtures import Tables

    monkeypatch.setattr(queries, "ROWS_PER_TASK", 50)
    folder = LogFolder(queries._written_log(Tables(spark, "/root/testdata/sf0.001")))
    events = Tables(spark, "/root/testdata/sf0.001").telemetry().count()
    commits = [folder.commit(n) for n in folder.numbers()]
    assert len(commits) == 4 and folder.last().records == events
    assert max(s.count for c in commits for s in c.segments) <= 100 < events / 8
