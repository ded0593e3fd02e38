"""Keys: last-wins dedup, collisions, upsert and insert-ignore as keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.schemas import INSTRUMENTATION


def dedup_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in the order of the columns ``order``, ties to the largest row.

    An aggregation with partial maxima, so duplicates meet before the shuffle and
    no key's rows are ever gathered.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in the order of the columns ``order``, ties to the least row."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def key_collisions(df: DataFrame, keys: list[str], ignored: list[str] | None = None) -> DataFrame:
    """Keys with rows that differ in a domain column, with their rows and number of variants.

    Instrumentation columns do not count; null equals null and NaN equals NaN.
    """
    ignored = INSTRUMENTATION if ignored is None else ignored
    domain = [c for c in df.columns if c not in keys and c not in ignored]
    found = df.groupBy(*keys).agg(F.count("*").alias("copies"), F.countDistinct(F.struct(*domain)).alias("variants"))
    return found.where("variants > 1")


def _absent(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the other table; null equals null, as in the aggregations that merge keys."""
    other = keys_of.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [rows[k].eqNullSafe(other[f"_{k}"]) for k in keys]
    return rows.join(other, same, "left_anti")


def upsert_merge(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after an upsert: a key's last new row replaces the old one, other rows stay."""
    fresh = dedup_last(new, keys, order).select(*old.columns)
    return _absent(old, fresh, keys).unionByName(fresh)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table after an insert that leaves existing keys alone; of new rows that share a key the first stays."""
    rows = dedup_first(new, keys, order)
    return old.unionByName(_absent(rows, old, keys).select(*old.columns))


def natural_key_check(df: DataFrame, keys: list[str], short: list[str]) -> DataFrame:
    """Rows, distinct keys, and distinct values of a shorter key, which shows what the key needs."""
    return df.agg(F.count("*").alias("row_count"), F.countDistinct(*keys).alias("distinct_keys"), F.countDistinct(*short).alias("distinct_short_keys")).withColumn("is_unique", F.col("row_count") == F.col("distinct_keys"))


def stable_partition(key: Column, partitions: int) -> Column:
    """A partition number that depends on the key's text alone, so a sensor's events keep their order."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("long") % partitions).cast("int")
