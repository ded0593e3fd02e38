"""Runs of zero readings on a stream: states shared by groups of sensors, readings put in order by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOUND = "building_id string, meter_type string, run_start timestamp, run_end timestamp, readings bigint"
#: Groups by a hash of the sensor, each with one state. A group with new readings rewrites the whole of its state.
BUCKETS = 1024
_STATE = "kept binary"
#: A row is a run of zeros, from its first reading to its last, n in number, or with n 0 another reading.
_KEPT = pa.schema([("building_id", pa.string()), ("meter_type", pa.string()), ("start", pa.int64()), ("last", pa.int64()), ("n", pa.int64())])


def _in_order(pending: list, run: tuple, horizon: int) -> tuple[list, tuple, list]:
    """Readings (micros, zero) before ``horizon`` taken into the run (start, last, n; n 0 without one): what stays, the run, and the runs that ended.

    For one sensor, a reading at a time: what ``_joined`` must agree with.
    """
    pending.sort()
    ready = sum(at < horizon for at, _ in pending)
    start, last, n = run
    ended = []
    for at, zero in pending[:ready]:
        if zero:
            start, last, n = (start if n else at), at, n + 1
        elif n:
            ended.append((start, last, n))
            n = 0
    return pending[ready:], (start, last, n), ended


def _joined(rows: pd.DataFrame, horizon: int, idle: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
    """Rows of many sensors (as ``_KEPT``), those before ``horizon`` joined to runs: what stays, the runs that ended, when the next is due.

    A run ends by another reading, or ``idle`` microseconds after its last one if
    the sensor has nothing else.
    """
    uses, kinds = pd.factorize(rows["meter_type"], use_na_sentinel=False)
    sensor = pd.factorize(rows["building_id"], use_na_sentinel=False)[0] * (len(kinds) + 1) + uses
    start, last, n = (rows[c].to_numpy(np.int64) for c in ("start", "last", "n"))
    ready = last < horizon
    at = np.flatnonzero(ready)
    at = at[np.lexsort((n[at] > 0, last[at], sensor[at]))]  # of one moment, other readings stand before zeros
    zero, mine = n[at] > 0, sensor[at]
    same = np.zeros(len(at), bool)  # as the row before: of this sensor, and both zeros
    same[1:] = (mine[1:] == mine[:-1]) & zero[1:] & zero[:-1]
    first = np.flatnonzero(zero & ~same)
    to = np.flatnonzero(zero & ~np.append(same[1:], False))
    runs = rows.iloc[at[first]].assign(last=last[at[to]])
    total = np.append(0, np.cumsum(n[at]))
    runs["n"] = total[to + 1] - total[first]
    following = np.append(mine[1:], -1)[to]
    ended = following == mine[to]  # the row behind a run is another reading of its sensor, or another sensor's
    waits = np.isin(mine[to], sensor[~ready])
    silent = ~ended & ~waits & (horizon >= runs["last"].to_numpy() + idle)
    stays, waiting = runs[~ended & ~silent], rows[~ready]
    due = [waiting["last"].min()] if len(waiting) else []
    due += [] if (~ended & ~silent & ~waits).sum() == 0 else [runs["last"].to_numpy()[~ended & ~silent & ~waits].min() + idle]
    return pd.concat([stays, waiting]), runs[ended | silent], int(min(due)) if due else None


def zero_runs_stream(events: DataFrame, least: int = 2, watermark: str = "2 minutes", idle_s: float = 7 * 86_400.0, buckets: int = BUCKETS) -> DataFrame:
    """Runs of at least ``least`` consecutive zero readings of a sensor, as a stream: see ``zero_runs``.

    Readings wait in the state until the watermark has passed them, so those that
    come out of order are put in order; later ones are dropped, as by any
    watermark. A run is given out once a reading other than zero has ended it, or
    once the watermark is ``idle_s`` beyond its last reading. What is kept of a
    sensor is its readings since the watermark and one run; a sensor without
    either keeps nothing. Sensors share the states of ``buckets`` groups, so a
    batch has as many steps at the most, each over the arrays of a group's
    readings; their number stays as it is for the life of a checkpoint.
    """
    idle = int(idle_s * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = []
        if state.exists:
            with pa.ipc.open_stream(bytes(state.get[0])) as kept:
                parts.append(kept.read_pandas())
        if not state.hasTimedOut:
            for frame in frames:
                micros = frame["micros"].to_numpy(np.int64)
                parts.append(pd.DataFrame({"building_id": frame["building_id"], "meter_type": frame["meter_type"], "start": micros, "last": micros, "n": frame["zero"].to_numpy(np.int64)}))
        now = state.getCurrentWatermarkMs() * 1000
        stays, ended, due = _joined(pd.concat(parts) if len(parts) > 1 else parts[0], now, idle)
        if len(stays):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, _KEPT) as kept:
                kept.write_table(pa.Table.from_pandas(stays, _KEPT, preserve_index=False))
            state.update((out.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(due // 1000 + 1, now // 1000 + 1))
        elif state.exists:
            state.remove()
        long = ended[ended["n"] >= least]
        if len(long):
            moments = [pd.to_datetime(long[c].to_numpy(), unit="us", utc=True) for c in ("start", "last")]
            yield pd.DataFrame({"building_id": long["building_id"].to_numpy(), "meter_type": long["meter_type"].to_numpy(), "run_start": moments[0], "run_end": moments[1], "readings": long["n"].to_numpy()})

    zero = F.coalesce(F.col("meter_reading") == 0, F.lit(False))
    bucket = F.pmod(F.xxhash64("building_id", "meter_type"), F.lit(buckets)).alias("bucket")
    # A reading without a time has no place in the order.
    timed = events.withWatermark("timestamp", watermark).where(F.col("timestamp").isNotNull())
    rows = timed.select(bucket, "building_id", "meter_type", "timestamp", F.unix_micros("timestamp").alias("micros"), zero.alias("zero"))
    return rows.groupBy("bucket").applyInPandasWithState(step, FOUND, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
