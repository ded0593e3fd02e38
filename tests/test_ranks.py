"""Ranks, percentiles and sketches against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions.quantiles import COARSE, exact_percentiles, merged_sketch, sketched_percentile, value_sketch
from wattline.functions.ranks import ranked
from wattline.operators.replay import sensor_ranks


@pytest.mark.parametrize("n, ranges", [(0, 4), (1, 4), (7, 4), (1000, 16), (1000, 1)])
def test_ranks_follow_the_order(spark, n, ranges):
    rng = random.Random(n)
    keys = sorted({f"{rng.choice('abé')}{rng.randrange(10 * n + 1)}" for _ in range(n)}, key=lambda x: x.encode())
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))], "k string").repartition(4)
    assert [(r["k"], r["at"]) for r in ranked(df, F.col("k"), "at", ranges).orderBy("at").collect()] == [(k, i) for i, k in enumerate(keys)]


def test_sensors_are_ranked_without_a_single_task(spark):
    rows = [(str(b), m) for b in range(300) for m in ("steam", "electricity")] * 2
    found = sensor_ranks(spark.createDataFrame(rows, "building_id string, meter_type string"))
    assert [(r["building_id"], r["meter_type"]) for r in found.orderBy("sensor_rank").collect()] == sorted(set(rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    single = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(single) <= 1  # the ranges' counts


def test_percentiles_far_apart(spark):
    """Values of a few cells, and some from very far away: coarse cells, and totals along the way."""
    rng = np.random.default_rng(3)
    values = np.concatenate((rng.exponential(2.0, 2000), rng.normal(1e6, 10, 300), [-5e8, 9e12]))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 7, "v double").repartition(3)
    wanted = {f"p{p}": p / 100 for p in (0, 1, 50, 88, 95, 100)}
    row = exact_percentiles(df, F.col("v"), wanted, 0.001, {"rows": (F.count("*"), F.sum("rows")), "largest": (F.max("x"), F.max("largest"))}).first()
    assert all(row[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-9) for name, p in wanted.items())
    assert row["rows"] == len(values) + 7 and row["largest"] == 9e12 and COARSE == 4096
    none = exact_percentiles(df.where("v > 1e13"), F.col("v"), wanted, 0.001).first()
    assert none.asDict() == dict.fromkeys(wanted)


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=20_000)
    df = spark.createDataFrame([(i % 30, float(v)) for i, v in enumerate(values)], "day int, v double").repartition(4)
    days = df.groupBy("day").agg(value_sketch(F.col("v")).alias("s"))
    row = days.agg(merged_sketch("s").alias("s")).select(*[sketched_percentile(F.col("s"), p).alias(f"p{p}") for p in (0.25, 0.5, 0.95)]).first()
    for p in (0.25, 0.5, 0.95):
        assert abs((values <= row[f"p{p}"]).mean() - p) < 0.0165
