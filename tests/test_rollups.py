"""Roll-ups: panels equal those over hourly metrics, for any range, and read fewer rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.metrics import METRICS
from wattline.plans.panels import PANELS, View
from wattline.plans.rollups import GRAINS, ROUTED, Rollups, pieces, routed
from wattline.schemas import METRIC_KEY
from wattline.streaming.sinks import KeyedTable

T0 = datetime(2024, 1, 30)
SCHEMA = T.StructType([*METRICS.fields, T.StructField("ingested_at", T.TimestampType())])


@pytest.fixture(scope="module")
def rollups(spark, tmp_path_factory):
    rng = random.Random(4)
    top = tmp_path_factory.mktemp("rollups")
    table = KeyedTable(spark, str(top / "hours"), SCHEMA, METRIC_KEY, ["ingested_at"], "window_start")
    found = Rollups(spark, str(top / "up"), table)
    rows = []
    for h in range(24 * 6):
        for site in (1, 2):
            n, at = rng.randrange(1, 9), T0 + timedelta(hours=h)
            rows.append((at, at + timedelta(hours=1), site, "Office", rng.choice(["steam", "electricity"]), n, 1, 1.0, float(n), 10.0 * n, 100.0 * n, n // 4, n // 8, at, 0.1, at))
    for n, part in enumerate((rows[:100], rows[100:250], rows[250:], rows[40:60])):  # the last batch comes twice
        batch = spark.createDataFrame(part, SCHEMA)
        table.upsert(batch)
        found.follow(batch, n)
    return found


def shown(df):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()]


VIEWS = [
    View(), View(start="2024-01-31 00:00:00", end="2024-02-03 00:00:00"), View(start="2024-01-30 05:30:00", end="2024-02-01 12:00:00", meter_type="steam"),
    View(start="2024-02-01 00:00:00"), View(end="2024-01-30 03:00:00"), View(start="2025-01-01 00:00:00", end="2025-01-02 00:00:00"), View(start="2024-01-30 07:00:00", end="2024-01-30 08:59:00", bucket="1 day"),
]


@pytest.mark.parametrize("view", VIEWS)
def test_panels_equal_those_over_hours(rollups, view):
    hours = rollups.metrics.read()
    for name in PANELS:
        if name in ROUTED or name == "panel_peak":
            assert shown(routed(rollups, name, view)) == shown(PANELS[name](hours, view)), name


def test_fewer_rows_are_read(rollups):
    hours = rollups.metrics.read().count()
    view = View(start="2024-01-30 05:00:00", end="2024-02-04 00:00:00")
    cut = pieces(view, GRAINS)
    assert [g.name for g, *_ in cut] == ["hour", "6 hours", "day", "hour"]
    read = 0
    for grain, first, end in cut:
        read += rollups.read(grain.name).where((F.col("window_start") >= F.lit(str(first)[:19]).cast("timestamp")) & (F.col("window_start") < F.lit(str(end)[:19]).cast("timestamp"))).count()
    assert read < hours / 6
    assert all(a[2] == b[1] for a, b in zip(cut, cut[1:]))


def test_refreshing_again_changes_nothing(rollups):
    before = {g.name: sorted(shown(rollups.read(g.name))) for g in GRAINS}
    rollups.refresh(["2024-02-01"])
    rollups.refresh()
    assert {g.name: sorted(shown(rollups.read(g.name))) for g in GRAINS} == before
    assert len(before["month"]) <= 8 and sum(r[-1] for r in before["month"]) == rollups.metrics.read().count()
