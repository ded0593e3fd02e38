"""Sending events as meters would: JSON lines in the order and at the pace of a replay schedule."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators.contract import build_payload
from wattline.operators.replay import replay_prepare, replay_schedule
from wattline.schemas import EVENT_KEY
from wattline.streaming.sinks import with_retries


def replay(events: DataFrame, out: str, speedup: float = 1000.0, connections: int = 4, sensors: int | None = None, limit: int | None = None, slice_s: float = 1.0, paced: bool = True, end=None, max_lag_s: float | None = None, attempts: int = 5, wait_s: float = 3.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> dict[str, float]:
    """Write the events' payloads as JSON lines under ``out``, a folder for each ``slice_s`` seconds of the schedule.

    Every sensor stays on one connection, a file of the folder each, and its
    payloads keep their order. Paced, a slice is written when it is due, with
    that moment as publish time; otherwise at once. Returns the number of events
    and slices, the seconds taken, the rate and by how much the worst slice was
    late. A slice that cannot be written for want of a connection is tried again;
    with ``max_lag_s`` the replay ends with an error once it is later than that.
    """
    chosen = replay_prepare(events, sensors, limit, end)
    due = replay_schedule(chosen, speedup, connections).select(*EVENT_KEY, "connection", "offset_s")
    placed = chosen.join(due, EVENT_KEY).withColumn("slice", F.floor(F.col("offset_s") / F.lit(slice_s)).cast("long")).persist()
    try:
        counts = {r["slice"]: r["count"] for r in placed.groupBy("slice").count().collect()}  # one row a slice
        began, worst = clock(), 0.0
        for n in sorted(counts):
            if paced:
                wait = began + n * slice_s - clock()
                if wait > 0:
                    sleep(wait)
                worst = max(worst, -wait)
                if max_lag_s is not None and worst > max_lag_s:
                    raise RuntimeError(f"slice {n} is {worst:.1f} s late, more than {max_lag_s:g} s")
            now = placed.where(F.col("slice") == n).withColumn("sim_publish_ts", F.timestamp_millis(F.lit(int(clock() * 1000))))
            lines = now.repartition(connections, "connection").sortWithinPartitions("connection", "offset_s", *EVENT_KEY)
            text = lines.select(build_payload(lines).alias("value"))
            with_retries(lambda text=text, n=n: text.write.mode("overwrite").text(f"{out.rstrip('/')}/slice={n:08d}"), attempts, wait_s, sleep=sleep)
        took = max(clock() - began, 1e-9)
        total = sum(counts.values())
        return {"events": total, "slices": len(counts), "seconds": took, "events_per_second": total / took, "worst_lag_s": worst}
    finally:
        placed.unpersist()
