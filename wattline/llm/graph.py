"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame) -> DataFrame:
    """(v, c): each node of ``links`` (columns a, b) with the smallest node of its component.

    Rounds of the alternating star contraction (every node's larger neighbours,
    then its smaller ones, are linked to its smallest neighbour) until the links
    (their number and the sum of their hashes) no longer change; each component ends as a star around its smallest node.
    The rounds grow with the logarithm of the largest component's size at the most, squared.
    """
    now = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours (and the node itself) to the smallest neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").unionByName(least.where("m <> a").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        # Smaller neighbours to the smallest one.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        new = checkpointed(small.select(F.col("m").alias("a"), "b").unionByName(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        now, before, seen = new, seen, _digest(new)
        if seen == before:
            break
    heads = now.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct()
    return now.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c")).unionByName(heads).groupBy("v").agg(F.min("c").alias("c"))
