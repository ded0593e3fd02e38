"""Metrics rolled up to longer windows, kept up to date batch by batch, and the coarsest rows that answer a panel exactly."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions.time import seconds
from wattline.operators.metrics import DIMENSIONS, MEASURES
from wattline.plans.panels import PANELS, View
from wattline.streaming.sinks import KeyedTable

#: Measures that add up, with their types, and the number of hourly windows in a row.
ADDITIVE = {m.name: m.kind for m in MEASURES if m.again} | {"windows": T.LongType()}
ROLLED = T.StructType([T.StructField("window_start", T.TimestampType()), *[T.StructField(x, kind) for x, kind in DIMENSIONS.items()], *[T.StructField(x, kind) for x, kind in ADDITIVE.items()]])
KEY = ["window_start", *DIMENSIONS]


@dataclass(frozen=True)
class Grain:
    """A length of windows: how Spark and how Python find the start of the one that holds a moment, and the start of the next."""

    name: str
    start: Callable[[Column], Column]
    floor: Callable[[datetime], datetime]
    next: Callable[[datetime], datetime]
    #: Seconds, where all windows have the same.
    length_s: int | None


def _fixed(name: str, hours: int) -> Grain:
    span = timedelta(hours=hours)
    zero = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return Grain(name, lambda c: F.window(c, f"{hours} hours")["start"], lambda t: t - (t - zero) % span, lambda t: t + span, hours * 3600)


HOUR = _fixed("hour", 1)
#: From the coarsest to the finest.
GRAINS = [
    Grain("month", lambda c: F.date_trunc("month", c), lambda t: t.replace(day=1, hour=0, minute=0, second=0, microsecond=0), lambda t: (t.replace(day=1) + timedelta(days=32)).replace(day=1, hour=0, minute=0, second=0, microsecond=0), None),
    _fixed("day", 24), _fixed("6 hours", 6),
]
#: Panels whose rows are sums over whole windows; True where they are sums a bucket.
ROUTED = {
    "panel_events": False, "panel_windows": False, "panel_meter_types": False, "panel_intensity": False, "panel_pct_zero": False, "panel_pct_anomaly": False, "panel_pct_valid": False, "panel_zero_groups": False,
    "panel_write_rate": True, "panel_consumption": True, "panel_site": True, "panel_quality_series": True,
}

#: Panels that show the whole table, whatever the view's range.
RANGELESS = {"panel_meter_types"}


def as_rows(metrics: DataFrame) -> DataFrame:
    """Hourly metrics as rows of the roll-ups."""
    return metrics.withColumn("windows", F.lit(1).cast("long")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROLLED])


def rolled_up(rows: DataFrame, grain: Grain) -> DataFrame:
    """Rows of finer windows summed up to a grain's."""
    again = {m.name: m.again(m.name) for m in MEASURES if m.again} | {"windows": F.sum("windows")}
    found = rows.withColumn("window_start", grain.start(F.col("window_start"))).groupBy(*KEY).agg(*[c.alias(k) for k, c in again.items()])
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROLLED])


class Rollups:
    """A table a grain under one folder, made from the hourly metrics table."""

    def __init__(self, spark: SparkSession, top: str, metrics: KeyedTable):
        """``top`` is the roll-ups' folder, ``metrics`` the hourly table."""
        self.metrics = metrics
        self.tables = {g.name: KeyedTable(spark, f"{top.rstrip('/')}/{g.name.replace(' ', '_')}", ROLLED, KEY, ["windows"], "window_start") for g in GRAINS}

    def refresh(self, days: list[str] | None = None) -> None:
        """Work out anew the windows that the given days (all without any) are in; with the same metrics again nothing changes.

        The days' six-hour and daily rows come from the hourly ones, the monthly
        rows from the daily ones of their months, so a batch costs as much as the days
        that it touches.
        """
        by_day = as_rows(self.metrics.read(days=days)).persist()
        try:
            for grain in GRAINS[1:]:
                self.tables[grain.name].upsert(rolled_up(by_day, grain))
        finally:
            by_day.unpersist()
        daily, month = self.tables["day"], GRAINS[0]
        touched = None if days is None else [d for d in daily.manifest() if d[:7] in {x[:7] for x in days}]
        self.tables[month.name].upsert(rolled_up(daily.read(days=touched), month))

    def follow(self, batch: DataFrame, batch_id: int) -> None:
        """Roll up the days of a batch of metrics that has just been written to their table; a ``foreachBatch`` function."""
        days = [r[0] for r in batch.select(self.metrics.day()).distinct().collect()]  # those of one batch
        if days:
            self.refresh(days)

    def read(self, name: str) -> DataFrame:
        return as_rows(self.metrics.read()) if name == HOUR.name else self.tables[name].read()


def _moment(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def _bucket_seconds(spark: SparkSession, bucket: str) -> float:
    zero = F.timestamp_micros(F.lit(0))
    return spark.range(1).select(seconds(zero + F.expr(f"interval {bucket}"), zero)).first()[0]


def pieces(view: View, grains: list[Grain]) -> list[tuple[Grain, datetime | None, datetime | None]]:
    """(grain, first, end): the view's range cut into stretches [first, end) of whole windows, each as coarse as it can be, hours at the edges.

    An open end of the range belongs to the coarsest grain.
    """
    first, last = _moment(view.start), _moment(view.end)
    # The view holds the windows that start from first to last; hourly ones start at whole hours.
    begin = None if first is None else HOUR.floor(first) if HOUR.floor(first) == first else HOUR.next(HOUR.floor(first))
    end = None if last is None else HOUR.next(HOUR.floor(last))

    def cut(a: datetime | None, b: datetime | None, left: list[Grain]) -> list[tuple[Grain, datetime | None, datetime | None]]:
        if a is not None and b is not None and a >= b:
            return []
        if not left:
            return [(HOUR, a, b)]
        grain, finer = left[0], left[1:]
        low = None if a is None else a if grain.floor(a) == a else grain.next(grain.floor(a))
        high = None if b is None else grain.floor(b)
        if low is not None and high is not None and low >= high:
            return cut(a, b, finer)
        before = cut(a, low, finer) if a is not None else []
        return [*before, (grain, low, high), *(cut(high, b, finer) if b is not None else [])]

    return cut(begin, end, grains)


def routed(rollups: Rollups, panel: str, view: View) -> DataFrame:
    """A panel's rows out of the coarsest tables that hold its range exactly; of any other panel, out of the hourly metrics."""
    if panel not in ROUTED:
        return PANELS[panel](rollups.metrics.read(), view)
    grains = GRAINS
    if ROUTED[panel]:
        bucket = _bucket_seconds(rollups.metrics.spark, view.bucket)
        grains = [g for g in GRAINS if g.length_s is not None and bucket % g.length_s == 0]
    parts = []
    at = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    for grain, first, end in pieces(View() if panel in RANGELESS else view, grains):
        rows = rollups.read(grain.name)
        rows = rows if first is None else rows.where(F.col("window_start") >= at(first))
        parts.append(rows if end is None else rows.where(F.col("window_start") < at(end)))
    if not parts:
        return PANELS[panel](rollups.read(HOUR.name).limit(0), view)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return PANELS[panel](whole, View(bucket=view.bucket, meter_type=view.meter_type, as_of=view.as_of))
