"""Ranks over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(key: Column, borders: list) -> Column:
    """How many of the sorted ``borders`` are at most ``key``, by a binary search."""
    if not borders:
        return F.lit(0)
    known, step = F.array(*[F.lit(b) for b in borders]), 1
    while step * 2 <= len(borders):
        step *= 2
    steps = []
    while step:
        steps.append(step)
        step //= 2
    inside = lambda at, s: (at + s <= len(borders)) & (F.try_element_at(known, (at + s).cast("int")) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(inside(at, s), at + s).otherwise(at))


def ranked(rows: DataFrame, key: Column, name: str, ranges: int = 256) -> DataFrame:
    """Add ``name``: the row's number from 0 in the order of ``key``, a text that no two rows share.

    A sample of at most four keys a range, chosen by a hash, tells the borders of
    ``ranges`` ranges; rows are numbered within their ranges, and the ranges' counts,
    a row each, give their first numbers. The numbers do not depend on the sample.
    """
    keyed = rows.withColumn("_key", key)
    found = sorted(r["_key"] for r in keyed.select("_key").where("_key is not null").orderBy(F.xxhash64("_key"), "_key").limit(4 * ranges).collect())
    borders = sorted(set(found[:: max(1, len(found) // ranges)][1:]))
    dealt = keyed.withColumn("_range", F.when(F.col("_key").isNull(), -1).otherwise(_bucket(F.col("_key"), borders)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    firsts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    return dealt.withColumn("_at", inside).join(F.broadcast(firsts), "_range").withColumn(name, (F.col("_first") + F.col("_at")).cast("long")).drop("_key", "_range", "_at", "_first")
