"""The data contract: schemas, domains and keys."""

from __future__ import annotations

from pyspark.sql import types as T

# The wire format of a meter type is its index here.
METER_TYPES = ["electricity", "chilledwater", "steam", "hotwater", "unknown"]
# Meter codes of the raw readings.
METER_CODES = {0: "electricity", 1: "chilledwater", 2: "steam", 3: "hotwater"}

EVENT_KEY = ["building_id", "meter_type", "timestamp"]
SENSOR_KEY = ["building_id", "meter_type"]
METRIC_KEY = ["window_start", "site_id", "primary_use", "meter_type"]
INSTRUMENTATION = ["sim_publish_ts", "ingested_at", "max_sim_publish_ts"]

EVENT = T.StructType([
    T.StructField("building_id", T.StringType()),
    T.StructField("meter_type", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("meter_reading", T.DoubleType()),
    T.StructField("sim_publish_ts", T.TimestampType()),
])
BUILDINGS = T.StructType([
    T.StructField("building_id", T.StringType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("primary_use", T.StringType()),
    T.StructField("square_feet", T.IntegerType()),
    T.StructField("year_built", T.IntegerType()),
    T.StructField("floor_count", T.IntegerType()),
])
BASELINE = T.StructType([
    T.StructField("building_id", T.StringType()),
    T.StructField("meter_type", T.StringType()),
    *[T.StructField(f"baseline_{x}", T.DoubleType()) for x in ("p25", "p50", "p75", "iqr")],
])
RAW_READINGS = T.StructType([
    T.StructField("building_id", T.IntegerType()),
    T.StructField("meter", T.IntegerType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("meter_reading", T.DoubleType()),
])
PROGRESS = T.StructType([
    T.StructField("trigger_ts", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("query_name", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("num_input_rows", T.LongType()),
    T.StructField("input_rows_per_second", T.DoubleType()),
    T.StructField("processed_rows_per_second", T.DoubleType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("add_batch_ms", T.LongType()),
    T.StructField("query_planning_ms", T.LongType()),
    T.StructField("sink_num_output_rows", T.LongType()),
    T.StructField("rows_dropped_by_watermark", T.LongType()),
    T.StructField("offsets_behind", T.LongType()),
    T.StructField("event_time_max", T.TimestampType()),
    T.StructField("watermark", T.TimestampType()),
])
PROGRESS_KEY = ["trigger_ts", "run_id", "query_name", "batch_id"]


def avro_schema(version: int = 1) -> dict:
    """The event's record schema; version 2 adds a nullable quality field with a default."""
    millis = {"type": "long", "logicalType": "timestamp-millis"}
    fields: list[dict] = [
        {"name": "building_id", "type": "string"},
        {"name": "meter_type", "type": {"type": "enum", "name": "MeterType", "symbols": METER_TYPES, "default": "unknown"}},
        {"name": "timestamp", "type": millis},
        {"name": "meter_reading", "type": "double"},
        {"name": "sim_publish_ts", "type": millis},
    ]
    if version == 2:
        fields.append({"name": "reading_quality", "type": ["null", "string"], "default": None})
    return {"type": "record", "name": "TelemetryEvent", "namespace": "telemetry", "fields": fields}
