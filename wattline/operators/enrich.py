"""Static enrichment of events: the building dimension and the per-sensor baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.anomaly import DEFAULT_FACTOR, is_anomaly, is_zero, ratio
from wattline.schemas import SENSOR_KEY


def with_dimension(events: DataFrame, buildings: DataFrame) -> DataFrame:
    """Left join on the building; events of unknown buildings stay, with nulls.

    Which side is small is left to the optimizer: it broadcasts the dimension
    under its size limit and re-plans at run time where statistics were wrong.
    """
    return events.join(buildings.select("building_id", "site_id", "primary_use", "square_feet"), "building_id", "left")


def with_baseline(events: DataFrame, baseline: DataFrame) -> DataFrame:
    """Left join on the sensor."""
    return events.join(baseline.select(*SENSOR_KEY, "baseline_p75", "baseline_iqr"), SENSOR_KEY, "left")


def enrich(events: DataFrame, buildings: DataFrame, baseline: DataFrame, factor: float = DEFAULT_FACTOR) -> DataFrame:
    """Events with dimension, baseline and both flags; usable on streams, with static tables."""
    joined = with_baseline(with_dimension(events, buildings), baseline)
    return joined.withColumns({"is_zero_reading": is_zero(F.col("meter_reading")), "is_anomaly": is_anomaly(F.col("meter_reading"), F.col("baseline_p75"), F.col("baseline_iqr"), factor)})


def event_intensity(events: DataFrame, buildings: DataFrame) -> DataFrame:
    """Reading per square foot of each event of a known building; null for an area of 0."""
    return events.join(buildings.select("building_id", "square_feet"), "building_id").withColumn("energy_intensity", ratio(F.col("meter_reading"), F.col("square_feet")))


def orphans(events: DataFrame, buildings: DataFrame) -> DataFrame:
    """Events of buildings that the dimension does not have."""
    return events.join(buildings.select("building_id"), "building_id", "left_anti")


def orphan_summary(events: DataFrame, buildings: DataFrame) -> DataFrame:
    return orphans(events, buildings).agg(F.count("*").alias("orphan_events"), F.countDistinct("building_id").alias("orphan_buildings"))


def orphan_topk(events: DataFrame, buildings: DataFrame, k: int = 10) -> DataFrame:
    counted = orphans(events, buildings).groupBy("building_id").agg(F.count("*").alias("events"))
    return counted.orderBy(F.col("events").desc(), "building_id").limit(k)


def star_anomalies(events: DataFrame, buildings: DataFrame, baseline: DataFrame, factor: float) -> DataFrame:
    """Anomalous events of known buildings and sensors at a threshold of the consumer's choice."""
    known = with_baseline(events.join(buildings.select("building_id", "site_id", "primary_use"), "building_id"), baseline)
    return known.where(is_anomaly(F.col("meter_reading"), F.col("baseline_p75"), F.col("baseline_iqr"), factor))


def anomaly_sweep(events: DataFrame, baseline: DataFrame, factors: tuple[float, ...] = (3.0, 5.0, 10.0)) -> DataFrame:
    """Share of anomalous events for several factors, in one pass."""
    joined = with_baseline(events, baseline)
    flags = [F.count_if(is_anomaly(F.col("meter_reading"), F.col("baseline_p75"), F.col("baseline_iqr"), k)).alias(f"n{i}") for i, k in enumerate(factors)]
    one = joined.agg(F.count("*").alias("events"), *flags)
    rows = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("factor"), F.col(f"n{i}").alias("anomalies")) for i, k in enumerate(factors)]))
    return one.select("events", rows.alias("r")).select("r.factor", "events", "r.anomalies", ratio(F.lit(100.0) * F.col("r.anomalies"), F.col("events")).alias("anomaly_pct"))
