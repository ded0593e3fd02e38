"""Resetting the state of a job: checkpoints, logs and tables go, reference tables only on request."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from wattline.streaming.sinks import KeyedTable


def reset_state(spark: SparkSession, checkpoint_dir: str, tables: list[KeyedTable], reference: list[KeyedTable] = (), everything: bool = False, logs: list[str] = (), drop_topic: Callable[[str], None] | None = None, topics: list[str] = ()) -> None:
    """Refuses while queries run, since they would write what has just been removed.

    ``logs`` are folders of file logs; topics are dropped by ``drop_topic``, a
    broker's own admin call, before the offsets that point into them go.
    """
    active = [q.name or str(q.id) for q in spark.streams.active]
    if active:
        raise RuntimeError(f"queries still running: {', '.join(active)}")
    if topics and drop_topic is None:
        raise ValueError("topics need a call that drops them")
    for topic in topics:
        drop_topic(topic)
    for folder in [*logs, checkpoint_dir]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for table in [*tables, *(reference if everything else [])]:
        table.truncate()
