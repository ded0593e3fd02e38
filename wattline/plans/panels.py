"""Dashboard panels over the metrics table, with typed parameters for time range, bucket and meter type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.anomaly import ratio
from wattline.functions.time import in_range, seconds


@dataclass(frozen=True)
class View:
    """What a dashboard has selected."""

    start: str | None = None
    end: str | None = None
    bucket: str = "6 hours"
    meter_type: str = "electricity"
    as_of: str | None = None

    def rows(self, metrics: DataFrame, meter: bool = False) -> DataFrame:
        kept = metrics.where(in_range(F.col("window_start"), self.start, self.end))
        return kept.where(F.col("meter_type") == self.meter_type) if meter else kept

    def by_bucket(self, metrics: DataFrame) -> DataFrame:
        return metrics.withColumn("time", F.window("window_start", self.bucket)["start"])


def _latency() -> Column:
    return seconds(F.col("ingested_at"), F.col("max_sim_publish_ts"))


def latency_p95(metrics: DataFrame, view: View) -> DataFrame:
    rows = view.rows(metrics).where("max_sim_publish_ts is not null")
    return rows.agg(F.percentile(_latency(), 0.95).alias("latency_p95_s"))


def data_age(metrics: DataFrame, view: View) -> DataFrame:
    now = F.current_timestamp() if view.as_of is None else F.lit(view.as_of).cast("timestamp")
    return metrics.agg(F.max("ingested_at").alias("last")).select(seconds(now, F.col("last")).alias("age_s"))


def _windows(metrics: DataFrame) -> Column:
    """The number of hourly windows; rows of roll-ups know how many they hold."""
    return F.sum("windows") if "windows" in metrics.columns else F.count("*")


def events(metrics: DataFrame, view: View) -> DataFrame:
    return view.rows(metrics).agg(F.sum("event_count").alias("events"))


def windows(metrics: DataFrame, view: View) -> DataFrame:
    return view.rows(metrics).agg(F.coalesce(_windows(metrics), F.lit(0)).alias("windows"))


def latency_series(metrics: DataFrame, view: View) -> DataFrame:
    rows = view.by_bucket(view.rows(metrics).where("max_sim_publish_ts is not null"))
    return rows.groupBy("time").agg(F.percentile(_latency(), 0.5).alias("p50_s"), F.percentile(_latency(), 0.95).alias("p95_s")).orderBy("time")


def write_rate(metrics: DataFrame, view: View) -> DataFrame:
    return view.by_bucket(view.rows(metrics)).groupBy("time").agg(F.sum("event_count").alias("events"), _windows(metrics).alias("windows")).orderBy("time")


def meter_types(metrics: DataFrame, view: View) -> DataFrame:
    return metrics.select("meter_type").distinct().orderBy("meter_type")


def _hourly(metrics: DataFrame, view: View, column: str = "sum_reading") -> DataFrame:
    return view.rows(metrics, meter=True).groupBy("window_start").agg(F.sum(column).alias("total"))


def peak(metrics: DataFrame, view: View) -> DataFrame:
    return _hourly(metrics, view).agg(F.max("total").alias("peak_demand"))


def base(metrics: DataFrame, view: View) -> DataFrame:
    return _hourly(metrics, view).agg(F.min("total").alias("base_load"))


def load_factor(metrics: DataFrame, view: View) -> DataFrame:
    return _hourly(metrics, view).agg(ratio(F.avg("total"), F.max("total")).alias("load_factor"))


def buildings(metrics: DataFrame, view: View) -> DataFrame:
    return _hourly(metrics, view, "distinct_buildings").agg(F.max("total").alias("buildings_reporting"))


def consumption(metrics: DataFrame, view: View) -> DataFrame:
    return view.by_bucket(view.rows(metrics)).groupBy("time", "meter_type").agg(F.sum("sum_reading").alias("consumption")).orderBy("time", "meter_type")


def load_profile(metrics: DataFrame, view: View) -> DataFrame:
    return view.rows(metrics, meter=True).groupBy(F.hour("window_start").alias("hour_of_day")).agg(F.sum("sum_reading").alias("consumption")).orderBy("hour_of_day")


def intensity(metrics: DataFrame, view: View) -> DataFrame:
    found = view.rows(metrics, meter=True).groupBy("primary_use").agg(ratio(F.sum("sum_reading"), F.sum("sum_square_feet")).alias("intensity"))
    return found.orderBy(F.col("intensity").desc_nulls_last(), "primary_use")


def site(metrics: DataFrame, view: View) -> DataFrame:
    rows = view.by_bucket(view.rows(metrics, meter=True))
    return rows.groupBy("time", F.concat(F.lit("site "), F.col("site_id").cast("string")).alias("site")).agg(F.sum("sum_reading").alias("consumption")).orderBy("time", "site")


def _share(part: str) -> Column:
    return ratio(F.lit(100.0) * F.sum(part), F.sum("event_count"))


def pct_zero(metrics: DataFrame, view: View) -> DataFrame:
    return view.rows(metrics).agg(_share("zero_count").alias("zero_pct"))


def pct_anomaly(metrics: DataFrame, view: View) -> DataFrame:
    return view.rows(metrics).agg(_share("anomaly_count").alias("anomaly_pct"))


def pct_valid(metrics: DataFrame, view: View) -> DataFrame:
    good = F.lit(100.0) * (F.sum("event_count") - F.sum("zero_count") - F.sum("anomaly_count"))
    return view.rows(metrics).agg(ratio(good, F.sum("event_count")).alias("valid_pct"))


def quality_series(metrics: DataFrame, view: View) -> DataFrame:
    return view.by_bucket(view.rows(metrics)).groupBy("time").agg(F.sum("zero_count").alias("zeros"), F.sum("anomaly_count").alias("anomalies")).orderBy("time")


def zero_groups(metrics: DataFrame, view: View, k: int = 15) -> DataFrame:
    found = view.rows(metrics).groupBy("site_id", "primary_use", "meter_type").agg(F.sum("zero_count").alias("zeros"), F.round(_share("zero_count"), 1).alias("zero_pct")).where("zeros > 0")
    return found.orderBy(F.col("zeros").desc(), "site_id", "primary_use", "meter_type").limit(k)


def recent_anomalies(metrics: DataFrame, view: View, k: int = 50) -> DataFrame:
    found = view.rows(metrics).where("anomaly_count > 0").select("window_start", "site_id", "primary_use", "meter_type", "anomaly_count", "event_count", F.round("max_reading", 1).alias("max_reading"))
    return found.orderBy(F.col("window_start").desc(), F.col("anomaly_count").desc(), "site_id", "primary_use", "meter_type").limit(k)


PANELS: dict[str, Callable[[DataFrame, View], DataFrame]] = {
    f"panel_{f.__name__}": f
    for f in (
        latency_p95, data_age, events, windows, latency_series, write_rate, meter_types, peak, base, load_factor, buildings, consumption,
        load_profile, intensity, site, pct_zero, pct_anomaly, pct_valid, quality_series, zero_groups, recent_anomalies,
    )
}
