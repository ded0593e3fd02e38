"""Batch preparation of the raw data set, and its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.quantiles import merged_sketch, sketched_percentile, value_sketch
from wattline.schemas import METER_CODES, SENSOR_KEY


def decode_meter(code: Column, codes: dict[int, str] | None = None) -> Column:
    """A meter code's name; an unknown code is an error."""
    names = F.create_map(*[F.lit(x) for pair in (codes or METER_CODES).items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.raise_error(F.concat(F.lit("unknown meter code "), F.coalesce(code.cast("string"), F.lit("null")))).cast("string"))


def sensor_baseline(telemetry: DataFrame) -> DataFrame:
    """Quartiles of each sensor's readings, linearly interpolated, and their range."""
    q = telemetry.groupBy(*SENSOR_KEY).agg(F.percentile("meter_reading", [0.25, 0.5, 0.75]).alias("q"))
    p = {f"baseline_p{n}": F.col("q")[i] for i, n in enumerate((25, 50, 75))}
    return q.select(*SENSOR_KEY, *[c.alias(k) for k, c in p.items()], (F.col("q")[2] - F.col("q")[0]).alias("baseline_iqr"))


def sensor_sketches(telemetry: DataFrame, window: str = "1 day") -> DataFrame:
    """By sensor and window, a sketch of its readings: what a baseline is updated from without reading its history again."""
    found = telemetry.groupBy(*SENSOR_KEY, F.window("timestamp", window).alias("w")).agg(F.count("*").alias("event_count"), value_sketch(F.col("meter_reading")).alias("readings"))
    return found.select(*SENSOR_KEY, F.col("w.start").alias("window_start"), "event_count", "readings")


def sketched_baseline(sketches: DataFrame) -> DataFrame:
    """The baseline out of sketches of any windows: quartiles within the sketch's rank error, readings themselves rather than between two."""
    merged = sketches.groupBy(*SENSOR_KEY).agg(merged_sketch("readings").alias("readings"))
    quartiles = {f"baseline_p{n}": sketched_percentile(F.col("readings"), n / 100) for n in (25, 50, 75)}
    found = merged.select(*SENSOR_KEY, *[c.alias(k) for k, c in quartiles.items()])
    return found.withColumn("baseline_iqr", F.col("baseline_p75") - F.col("baseline_p25"))


def prepare(train: DataFrame, metadata: DataFrame, sites: list[int], codes: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw readings and metadata of the chosen sites as (telemetry, buildings, baseline); zeros are kept."""
    chosen = metadata.where(F.col("site_id").isin(*sites))
    telemetry = train.join(chosen.select("building_id"), "building_id").select(F.col("building_id").cast("string").alias("building_id"), decode_meter(F.col("meter"), codes).alias("meter_type"), F.col("timestamp").cast("timestamp").alias("timestamp"), "meter_reading")
    buildings = chosen.withColumn("building_id", F.col("building_id").cast("string"))
    return telemetry, buildings, sensor_baseline(telemetry)


def write_prepared(telemetry: DataFrame, buildings: DataFrame, baseline: DataFrame, out: str) -> dict[str, str]:
    """The three tables as Parquet under ``out``: telemetry in the order of a replay, the others as they are."""
    paths = {name: f"{out.rstrip('/')}/{name}.parquet" for name in ("telemetry", "buildings", "baseline")}
    telemetry.repartitionByRange("timestamp").sortWithinPartitions("timestamp", *SENSOR_KEY).write.mode("overwrite").parquet(paths["telemetry"])
    buildings.write.mode("overwrite").parquet(paths["buildings"])
    baseline.write.mode("overwrite").parquet(paths["baseline"])
    return paths


def flat_sensors(baseline: DataFrame) -> DataFrame:
    """Sensors, and those whose quartiles coincide: of these no reading is ever an anomaly."""
    return baseline.agg(F.count("*").alias("sensors"), F.count_if(F.col("baseline_iqr") == 0).alias("flat_sensors"))


def dataset_profile(telemetry: DataFrame) -> DataFrame:
    """Size, span, completeness and share of zeros of a telemetry table."""
    return telemetry.agg(
        F.count("*").alias("events"), F.countDistinct(*SENSOR_KEY).alias("sensors"), F.countDistinct("building_id").alias("buildings"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"),
        F.count_if(F.col("meter_reading").isNull() | F.col("timestamp").isNull()).alias("null_rows"), (F.lit(100.0) * F.count_if(F.col("meter_reading") == 0) / F.count("*")).alias("zero_pct"),
    )


def meter_type_counts(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("meter_type").agg(F.count("*").alias("events"), F.countDistinct("building_id").alias("buildings"))


def null_shares(table: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the number and share of nulls, in one pass."""
    one = table.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns]))
    return one.select("n", rows.alias("r")).select("r.column_name", "r.nulls", (F.lit(100.0) * F.col("r.nulls") / F.col("n")).alias("null_pct"))
