"""Numbering of all rows, or of each group's rows, without gathering any group in one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, session_of, spare, task_count

_ROW = (1 << 33) - 1


def gapless(df: DataFrame, name: str, bucket: Column, order: list[str], restart: bool = False, weight: str | None = None, ahead: str | None = None, rank: str | None = None, ranks: int = 0) -> DataFrame:
    """Add ``name``: the row's number from 0, bucket by bucket (``restart``: from 0 in each bucket).

    With ``weight`` and ``ahead``, also add the sum of ``weight`` over the rows
    before it in the same order. Within a bucket the order is that of a hash of
    the ``order`` columns, then these columns. Rows are dealt by bucket and a
    slice of the hash, so a bucket with most of the rows still spreads over all
    tasks; the totals of the (bucket, slice) cells, which number
    buckets x tasks, give each cell's first number. With ``rank``, a column of
    whole numbers from 0 to below ``ranks``, the order within a bucket is that of
    the rank in place of the hash, and slices are ranges of the rank.
    """
    n = 4 * task_count(session_of(df))
    h = F.col(rank) if rank else F.xxhash64(*order)
    share = F.col("_hash").cast("double") / float(max(ranks, 1)) if rank else F.shiftrightunsigned(F.col("_hash"), 11).cast("double") / float(1 << 53)
    keyed = df.withColumn("_bucket", bucket).withColumn("_hash", h).withColumn("_slice", F.floor(share * n).cast("int"))
    inside = Window.partitionBy("_bucket", "_slice").orderBy("_hash", *order)
    value = F.col(weight) if weight else F.lit(0)
    cells = keyed.groupBy("_bucket", "_slice").agg(F.count("*").alias("_n"), F.sum(value).alias("_w"))
    before = Window.orderBy("_bucket", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    if restart:
        before = Window.partitionBy("_bucket").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("_bucket", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_ahead"))
    keyed = keyed.withColumn("_row", F.row_number().over(inside) - 1)
    if ahead:
        keyed = keyed.withColumn("_sum", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = keyed.join(firsts, ["_bucket", "_slice"]).withColumn(name, (F.col("_first") + F.col("_row")).cast("long"))
    if ahead:
        out = out.withColumn(ahead, (F.col("_ahead") + F.col("_sum")).cast("long"))
    return out.drop("_bucket", "_hash", "_slice", "_row", "_first", "_ahead", "_sum")


def ranked_by(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add ``name``: the row's number from 0 in the order of columns: its place in a range partition after the rows of the partitions before."""
    dealt = df.repartitionByRange(task_count(session_of(df)), *order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def with_layout(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with ``name``, numbers that rise in the order in which its rows lie, and a bound above all of them.

    Of a table read from files that is the order of the files' names, as Spark
    numbers them in writing, and of the rows in each; otherwise that of the partitions.
    """
    try:
        known = df.withColumns({name: F.col("_metadata.row_index"), (at := spare([*df.columns, name], "_file")[0]): F.col("_metadata.file_name")})
    except AnalysisException:
        return df.withColumn(name, F.monotonically_increasing_id()), max(1, df.rdd.getNumPartitions()) << 33
    (other, number) = spare([*known.columns], "_other", "_number")
    files = known.select(F.col(at).alias(other)).distinct().withColumn(number, F.row_number().over(Window.orderBy(other)) - 1)  # one row a file
    placed = known.join(F.broadcast(files), F.col(at) == F.col(other)).withColumn(name, F.col(number).cast("long") * F.lit(1 << 33) + F.col(name))
    return placed.drop(at, other, number), max(1, files.count()) << 33
