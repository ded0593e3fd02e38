"""Flags of a reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FACTOR = 5.0


def is_zero(reading: Column) -> Column:
    """Reading equals zero; unknown for a null reading."""
    return reading == 0


def is_anomaly(reading: Column, p75: Column, iqr: Column, factor: float = DEFAULT_FACTOR) -> Column:
    """Reading strictly above p75 + factor * iqr; false without a baseline or with an iqr of 0."""
    return iqr.isNotNull() & (iqr > 0) & (reading > p75 + F.lit(float(factor)) * iqr)


def count_true(flag: Column) -> Column:
    """Rows where the flag is true; null counts as no."""
    return F.sum(F.when(flag, 1).otherwise(0)).cast("long")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is 0 or null."""
    return numerator / F.when(denominator != 0, denominator)
