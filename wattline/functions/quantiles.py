"""Percentiles of a whole table without gathering its values: exact ones in two passes, and mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a histogram that make up a coarse one.
COARSE = 4096
#: Rank error of a KLL sketch of the default size, at a confidence of 99 %: about 1.65 %.
KLL_K, KLL_ERROR = 200, 0.0165


def exact_percentiles(df: DataFrame, value: Column, wanted: dict[str, float], width: float, also: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """One row with a column for each of ``wanted`` (name to share): linearly interpolated, null without values.

    One pass makes a histogram of cells of ``width``; it tells in which cells the
    wanted ranks fall, two for each share at the most. A second pass takes the
    values of these cells alone, each with its count, and puts them in order.
    Ranks are found first among coarse cells of ``COARSE`` cells, then in the few
    coarse cells that hold them, so what meets in one task is a row a coarse cell.

    ``also`` names further aggregates of all rows that the first pass makes along
    the way: what is computed in a cell (over ``x``, the value), and what of the
    cells' results (over the column of that name) is the result.
    """
    also = also or {}
    x = df.select(value.cast("double").alias("x")).withColumn("cell", F.floor(F.col("x") / F.lit(width)))
    cells = x.groupBy("cell").agg(F.count("*").alias("n"), *[part.alias(name) for name, (part, _) in also.items()])
    known = cells.where("cell is not null").withColumn("coarse", F.floor(F.col("cell") / COARSE))
    before = F.sum("m").over(Window.orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1))
    placed = known.groupBy("coarse").agg(F.sum("n").alias("m")).select("coarse", "m", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    at = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in wanted.items()}
    ranks = [
        F.struct(F.lit(name).alias("name"), F.floor(a).alias("rank"), (F.floor(a) + 1 - a).alias("share")) for name, a in at.items()
    ] + [F.struct(F.lit(name).alias("name"), (F.floor(a) + 1).alias("rank"), (a - F.floor(a)).alias("share")) for name, a in at.items()]
    chosen = placed.select("coarse", "m", "before", F.explode(F.array(*ranks)).alias("r")).select("coarse", "m", (F.col("r.rank") - F.col("before")).alias("rank"), "r.name", "r.share").where("rank >= 0 and rank < m and share > 0")
    inside = Window.partitionBy("coarse").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    fine = known.join(F.broadcast(chosen.select("coarse").distinct()), "coarse").select("coarse", "cell", "n", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before"))  # two coarse cells a share
    picks = fine.join(F.broadcast(chosen), "coarse").select("cell", "n", (F.col("rank") - F.col("before")).alias("rank"), "name", "share").where("rank >= 0 and rank < n")
    values = x.join(F.broadcast(picks.select("cell").distinct()), "cell").groupBy("cell", "x").agg(F.count("*").alias("m"))  # two cells a share
    upto = values.withColumn("upto", F.sum("m").over(Window.partitionBy("cell").orderBy("x")))
    met = upto.join(F.broadcast(picks), "cell").where("rank < upto and rank >= upto - m")
    found = met.agg(*[F.sum(F.when(F.col("name") == name, F.col("share") * F.col("x"))).alias(name) for name in wanted])
    return found if not also else cells.agg(*[whole.alias(name) for name, (_, whole) in also.items()]).crossJoin(found)  # a row each


def value_sketch(value: Column) -> Column:
    """An aggregate: a KLL sketch of the values, which further ones merge with."""
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(KLL_K))


def merged_sketch(sketch: str) -> Column:
    """An aggregate: the sketch of all values that the sketches have seen."""
    return F.kll_merge_agg_double(sketch, F.lit(KLL_K))


def sketched_percentile(sketch: Column, share: float) -> Column:
    """The value at a share of the ranks, within ``KLL_ERROR`` of it."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))
