"""Readers that need what this machine lacks, by their options; exact percentiles against sorted values."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions.quantiles import exact_percentiles
from wattline.sources.readers import read_excel, sql_options


def test_excel_through_pandas(spark, monkeypatch):
    monkeypatch.setattr(pd, "read_excel", lambda path: pd.DataFrame({"building_id": [1, 2], "use": ["Office", path]}))
    assert [tuple(r) for r in read_excel(spark, "x.xlsx", "building_id long, use string").collect()] == [(1, "Office"), (2, "x.xlsx")]


def test_sql_options():
    assert sql_options("jdbc:x", "select 1") == {"url": "jdbc:x", "query": "select 1"}
    assert sql_options("jdbc:x", "select 1", ("id", 0, 9, 3)) == {"url": "jdbc:x", "dbtable": "(select 1) as q", "partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}


@pytest.mark.parametrize("values", [[], [None], [3.5], [1.0, 2.0], [0.25] * 50, "random", "negative"])
def test_exact_percentiles(spark, values):
    rng = random.Random(5)
    if isinstance(values, str):
        values = [rng.choice([rng.gauss(-5 if values == "negative" else 5, 3), 1.25, None]) for _ in range(999)]
    shares = {"low": 0.0, "mid": 0.5, "odd": 0.377, "high": 0.95, "top": 1.0}
    df = spark.createDataFrame([(x,) for x in values], "v double").repartition(3)
    out = exact_percentiles(df, F.col("v"), shares, 0.5).first()
    kept = [x for x in values if x is not None]
    for name, p in shares.items():
        assert out[name] is None if not kept else abs(out[name] - np.quantile(kept, p)) < 1e-9
