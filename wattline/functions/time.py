"""Event time: one zone, one type inside the engine, zone-less at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_engine(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as instants of the session's zone (UTC): watermarks need instants."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def to_boundary(df: DataFrame) -> DataFrame:
    """Instants as zone-less timestamps, for consumers that know UTC only."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, T.TimestampType)})


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two instants, as a double with microseconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def plus_millis(moment: Column, millis: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + millis.cast("long") * 1000)


def in_range(moment: Column, start: str | None, end: str | None) -> Column:
    """start <= moment <= end; either may be open."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (moment >= F.lit(start).cast("timestamp"))
    if end is not None:
        ok = ok & (moment <= F.lit(end).cast("timestamp"))
    return ok
