"""Deterministic replay of historical events: subset, order, limit, rebase, schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.ranks import ranked
from wattline.schemas import EVENT_KEY, SENSOR_KEY

ORDER = ["timestamp", "building_id", "meter_type"]


def sensor_subset(events: DataFrame, sensors: int | None) -> DataFrame:
    """Events of the first sensors in text order; growing numbers give growing, nested sets; 0 or None gives all."""
    if not sensors:
        return events
    chosen = events.select(*SENSOR_KEY).distinct().orderBy(*SENSOR_KEY).limit(sensors)
    return events.join(chosen, SENSOR_KEY, "left_semi")


def replay_order(events: DataFrame) -> DataFrame:
    """By time, ties by sensor: a total order on the natural key."""
    return events.orderBy(*ORDER)


def replay_prefix(events: DataFrame, limit: int | None) -> DataFrame:
    """The first events in replay order (limit after sort)."""
    return replay_order(events).limit(limit) if limit else replay_order(events)


def rebase(events: DataFrame, end: Column) -> DataFrame:
    """All times shifted alike, so that the last becomes ``end``; gaps stay as they are."""
    last = F.broadcast(events.agg(F.max(F.unix_micros("timestamp")).alias("_last")))  # one row
    moved = events.join(last).withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + F.unix_micros(end.cast("timestamp")) - F.col("_last")))
    return moved.drop("_last")


def replay_prepare(events: DataFrame, sensors: int | None = None, limit: int | None = None, end: Column | None = None) -> DataFrame:
    """Subset, order, limit and rebase, in this order."""
    chosen = replay_prefix(sensor_subset(events, sensors), limit)
    return chosen if end is None else rebase(chosen, end)


def sensor_ranks(events: DataFrame) -> DataFrame:
    """Sensors numbered from 0 in text order; one row a sensor is numbered, in ranges of the order."""
    sensors = events.select(*SENSOR_KEY).distinct()
    # A separator below all others keeps the order that of the columns.
    return ranked(sensors, F.concat_ws("\x00", *SENSOR_KEY), "sensor_rank")


def replay_schedule(events: DataFrame, speedup: float, connections: int, cadence_s: float = 3600.0) -> DataFrame:
    """When each event is due, in seconds from the start, and on which connection.

    A sensor stays on one connection (round robin over the ranks), and sensors
    are spread over one cadence so that they do not all fire at once.
    """
    ranks = sensor_ranks(events)
    facts = F.broadcast(events.agg(F.min(F.unix_micros("timestamp")).alias("_t0")).join(ranks.agg(F.count("*").alias("_n"))))  # one row
    offset = (F.unix_micros("timestamp") - F.col("_t0")) / F.lit(1e6) / F.lit(float(speedup)) + F.col("sensor_rank") / F.col("_n") * F.lit(cadence_s) / F.lit(float(speedup))
    joined = events.join(ranks, SENSOR_KEY).join(facts)
    return joined.withColumns({"connection": F.col("sensor_rank") % connections, "offset_s": offset}).select(*EVENT_KEY, "sensor_rank", "connection", "offset_s")


def agendas(schedule: DataFrame, connections: int) -> DataFrame:
    """The schedule laid out for sending: one partition a connection, each in time order."""
    return schedule.repartition(connections, "connection").sortWithinPartitions("connection", "offset_s", *ORDER)


def theoretical_rate(events: DataFrame, speedup: float, cadence_s: float = 3600.0) -> DataFrame:
    """Events a second of all sensors together at their cadence."""
    return events.agg((F.countDistinct(*SENSOR_KEY) * F.lit(float(speedup)) / F.lit(cadence_s)).alias("events_per_second"), F.countDistinct(*SENSOR_KEY).alias("sensors"))
