"""Every registered query of the telemetry engine, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions import wire
from wattline.functions.cluster import scratch
from wattline.functions.quantiles import KLL_ERROR
from wattline.functions.time import to_boundary
from wattline.operators import contract, dedup, enrich, metrics, prepare, replay
from wattline.operators.metrics import METRICS
from wattline.plans import kpi
from wattline.plans.panels import PANELS, View
from wattline.plans.rollups import Rollups, routed
from wattline.schemas import BUILDINGS, EVENT_KEY, METRIC_KEY, PROGRESS_KEY, SENSOR_KEY, avro_schema
from wattline.sources.fixtures import AS_OF, DOMAIN, Tables
from wattline.sources.log import append_log, read_log
from wattline.sources.readers import read_any, row_counts
from wattline.streaming import ingest, job
from wattline.streaming.runs import FOUND, zero_runs_stream
from wattline.streaming.runtime import JobOptions, log_source
from wattline.streaming.sinks import KeyedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "telemetry": """select cast(user_id as varchar) as building_id, event_type as meter_type, ts as "timestamp", cast(floor(value) as double) as meter_reading,
        ts as sim_publish_ts, ts + to_milliseconds(event_id % 2000) as ingested_at, event_id from events""",
    "buildings": """select cast(s_suppkey as varchar) as building_id, s_nationkey as site_id, r_name as primary_use, cast(floor(s_acctbal) as double) as square_feet,
        case when s_suppkey % 3 <> 0 then cast(s_suppkey % 100 + 1900 as integer) end as year_built, case when s_suppkey % 5 = 0 then cast(s_suppkey % 7 + 1 as integer) end as floor_count
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "baseline": """select building_id, meter_type, quantile_cont(meter_reading, 0.25) as baseline_p25, quantile_cont(meter_reading, 0.5) as baseline_p50, quantile_cont(meter_reading, 0.75) as baseline_p75,
        quantile_cont(meter_reading, 0.75) - quantile_cont(meter_reading, 0.25) as baseline_iqr from telemetry group by building_id, meter_type""",
    "enriched": """select t.*, b.site_id, b.primary_use, b.square_feet, l.baseline_p75, l.baseline_iqr, t.meter_reading = 0 as is_zero_reading,
        coalesce(l.baseline_iqr > 0 and t.meter_reading > l.baseline_p75 + 5 * l.baseline_iqr, false) as is_anomaly
        from telemetry t left join buildings b on b.building_id = t.building_id left join baseline l on l.building_id = t.building_id and l.meter_type = t.meter_type""",
    "metrics": """select *, max_sim_publish_ts + to_milliseconds(event_count * 250) as ingested_at from (
        select date_trunc('hour', "timestamp") as window_start, date_trunc('hour', "timestamp") + interval 1 hour as window_end, site_id, primary_use, meter_type,
        count(*) as event_count, count(distinct building_id) as distinct_buildings, avg(meter_reading) as avg_reading, max(meter_reading) as max_reading, sum(meter_reading) as sum_reading, sum(square_feet) as sum_square_feet,
        case when sum(square_feet) > 0 then sum(meter_reading) / sum(square_feet) end as avg_energy_intensity,
        cast(sum(case when is_zero_reading then 1 else 0 end) as bigint) as zero_count, cast(sum(case when is_anomaly then 1 else 0 end) as bigint) as anomaly_count, max(sim_publish_ts) as max_sim_publish_ts
        from enriched where site_id is not null group by all)""",
    "faulty": """select *, event_id % 25 as fault, date_trunc('second', "timestamp") as stamp, date_trunc('milliseconds', sim_publish_ts) as published from telemetry""",
    "rejects": """select event_id, case fault when 0 then 'not a JSON object' when 1 then 'missing field ''meter_reading''' when 2 then 'meter_type outside its domain: ''gas''' when 3 then 'timestamp not ISO-8601: ''yesterday'''
        when 4 then 'wrong type of ''building_id''' when 5 then 'timestamp in the future (2099-01-01 00:00:00)' when 6 then 'meter_reading negative (' || cast(-1 - meter_reading as varchar) || ')' else 'meter_reading not finite (NaN)' end as error,
        case when fault = 0 then '{"building_id":' else '{"building_id": ' || case when fault = 4 then building_id else '"' || building_id || '"' end
        || ', "meter_type": "' || case when fault = 2 then 'gas' else meter_type end || '", "timestamp": "' || case when fault = 3 then 'yesterday' when fault = 5 then '2099-01-01T00:00:00' else strftime(stamp, '%Y-%m-%dT%H:%M:%S') end || '"'
        || case fault when 1 then '' when 6 then ', "meter_reading": ' || cast(-1 - meter_reading as varchar) when 7 then ', "meter_reading": NaN' else ', "meter_reading": ' || cast(meter_reading as varchar) end
        || ', "sim_publish_ts": ' || epoch_us(sim_publish_ts) // 1000 || '}' end as payload from faulty where fault < 8""",
    "deliveries": """select building_id, meter_type, "timestamp", meter_reading, sim_publish_ts, event_id as seq from telemetry
        union all select building_id, meter_type, "timestamp", meter_reading + case when event_id % 50 = 0 then 1.0 else 0.0 end, sim_publish_ts + to_milliseconds(1500), event_id + 1000000000 from telemetry where event_id % 10 = 0""",
    "log": """select *, row_number() over (partition by "partition" order by event_id) - 1 as "offset" from (
        select *, building_id || ':' || meter_type as "key", cast(cast('0x' || substr(md5(building_id || ':' || meter_type), 1, 6) as bigint) % 3 as integer) as "partition" from telemetry)""",
    "progress": """select h as trigger_ts, case when h < timestamp '2024-01-16' then 'run1' else 'run2' end as run_id, event_type as query_name, cast(epoch(h) / 3600 as bigint) as batch_id,
        rows_in as num_input_rows, rows_in * 1000.0::double / (total % 1000 + 1) as processed_rows_per_second, total % 1000 + 1 as duration_ms
        from (select event_type, date_trunc('hour', ts) as h, case when hour(date_trunc('hour', ts)) % 5 = 0 then 0 else count(*) end as rows_in, cast(sum(floor(value)) as bigint) as total from events group by 1, 2)""",
    "rungs": """select 'day ' || lpad(cast(d as varchar), 2, '0') as label, cast(d * 10 as integer) as sensors, cast(n as double) as requested_rate, n * case when d % 7 = 0 then 0.9::double else 1.0::double end as published_rate, latency_p95_s, d = 30 as hot_base
        from (select day(ts) as d, count(*) as n, cast(max(floor(value)) as double) as latency_p95_s from events group by 1)""",
}
_WITH = "with " + ",\n".join(f"{name} as ({body})" for name, body in CTES.items())


def query(sql: str | None = None, name: str | None = None):
    """Register a query over ``Tables`` under its function's name."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: to_boundary(f(Tables(spark, folder)))
        if sql is not None:
            ORACLES[key] = f"{_WITH}\n{sql}"
        return f

    return add


# --- scans and profile -------------------------------------------------------
@query("select building_id, site_id, primary_use, square_feet from buildings")
def scan_dimension(t: Tables) -> DataFrame:
    return t.buildings().select("building_id", "site_id", "primary_use", "square_feet")


@query("select building_id, meter_type, baseline_p75, baseline_iqr from baseline")
def scan_baseline(t: Tables) -> DataFrame:
    return t.baseline().select(*SENSOR_KEY, "baseline_p75", "baseline_iqr")


@query("select * from baseline")
def sensor_baseline(t: Tables) -> DataFrame:
    return t.baseline()


@query("""select count(*) as events, count(distinct (building_id, meter_type)) as sensors, count(distinct building_id) as buildings, min("timestamp") as first_event, max("timestamp") as last_event,
    count(*) filter (where meter_reading is null or "timestamp" is null) as null_rows, 100.0::double * count(*) filter (where meter_reading = 0) / count(*) as zero_pct from telemetry""")
def dataset_profile(t: Tables) -> DataFrame:
    return prepare.dataset_profile(t.telemetry())


@query("select count(*) as sensors, count(*) filter (where baseline_iqr = 0) as flat_sensors from baseline")
def flat_sensors(t: Tables) -> DataFrame:
    return prepare.flat_sensors(t.baseline())


@query("""select count(*) as row_count, count(distinct (building_id, meter_type, "timestamp")) as distinct_keys, count(distinct (building_id, "timestamp")) as distinct_short_keys,
    count(*) = count(distinct (building_id, meter_type, "timestamp")) as is_unique from telemetry""")
def natural_key_check(t: Tables) -> DataFrame:
    return dedup.natural_key_check(t.telemetry(), EVENT_KEY, ["building_id", "timestamp"])


@query("""select 'telemetry' as table_name, count(*) as row_count from telemetry union all select 'buildings', count(*) from buildings union all select 'baseline', count(*) from baseline""")
def table_counts(t: Tables) -> DataFrame:
    return row_counts({"telemetry": t.telemetry(), "buildings": t.buildings(), "baseline": t.baseline()})


@query("select meter_type, count(*) as events, count(distinct building_id) as buildings from telemetry group by 1")
def meter_type_counts(t: Tables) -> DataFrame:
    return prepare.meter_type_counts(t.telemetry())


@query("""select 'year_built' as column_name, count(*) - count(year_built) as nulls, 100.0::double * (count(*) - count(year_built)) / count(*) as null_pct from buildings
    union all select 'floor_count', count(*) - count(floor_count), 100.0::double * (count(*) - count(floor_count)) / count(*) from buildings""")
def dimension_nulls(t: Tables) -> DataFrame:
    return prepare.null_shares(t.buildings(), ["year_built", "floor_count"])


@query('select count(*) as partitions, cast(sum(depth) as bigint) as depth from (select max("offset") - min("offset") + 1 as depth from log group by "partition")')
def log_depth(t: Tables) -> DataFrame:
    return contract.log_depth(t.log())


@query('select "key", "partition", count(*) as records, min("offset") as first_offset, max("offset") as last_offset from log group by 1, 2')
def log_partitioning(t: Tables) -> DataFrame:
    return t.log().groupBy("key", "partition").agg(F.count("*").alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query("select building_id, site_id, primary_use, cast(square_feet as integer) as square_feet, year_built, floor_count from buildings")
def scan_csv(t: Tables) -> DataFrame:
    """The dimension as CSV files, read by their extension and the declared schema."""
    path = f"{scratch(t.spark, 'dimension')}.csv"
    t.buildings().withColumn("square_feet", F.col("square_feet").cast("int")).select(*BUILDINGS.fieldNames()).write.option("header", True).csv(path)
    return read_any(t.spark, path, BUILDINGS)


@query("""select 'telemetry' as table_name, count(*) as row_count from telemetry where building_id in (select building_id from buildings where site_id in (2, 3, 5)) union all select 'buildings', count(*) from buildings where site_id in (2, 3, 5)
    union all select 'baseline', count(*) from (select distinct building_id, meter_type from telemetry where building_id in (select building_id from buildings where site_id in (2, 3, 5)))""")
def prepared_tables(t: Tables) -> DataFrame:
    """The three prepared tables, written and read again."""
    written = prepare.write_prepared(*prepare.prepare(t.train(), t.metadata(), [2, 3, 5], dict(enumerate(DOMAIN))), scratch(t.spark, "prepared"))
    return row_counts({name: t.spark.read.parquet(path) for name, path in written.items()})


# --- wire and contract -------------------------------------------------------
def _valid_schema() -> dict:
    schema = avro_schema()
    schema["fields"][1]["type"] = {"type": "enum", "name": "MeterType", "symbols": DOMAIN}
    return schema


@query("select event_id, cast(300 as bigint) as schema_id, meter_type as payload, length(meter_type) + 5 as value_bytes from telemetry")
def wire_header(t: Tables) -> DataFrame:
    framed = t.telemetry().select("event_id", wire.encode_header(F.lit(300), F.col("meter_type").cast("binary")).alias("value"))
    return wire.split_header(framed).select("event_id", "schema_id", F.col("payload").cast("string").alias("payload"), F.length("value").cast("long").alias("value_bytes"))


@query("select meter_type, count(*) as events, sum(meter_reading) as sum_reading from telemetry group by 1")
def schema_guard(t: Tables) -> DataFrame:
    return wire.guard_schema(t.telemetry().withColumn("schema_id", F.lit(300)), 300).groupBy("meter_type").agg(F.count("*").alias("events"), F.sum("meter_reading").alias("sum_reading"))


@query("""select "partition", "offset", building_id, meter_type, date_trunc('milliseconds', "timestamp") as "timestamp", meter_reading, date_trunc('milliseconds', sim_publish_ts) as sim_publish_ts from log""")
def avro_decode(t: Tables) -> DataFrame:
    schema = _valid_schema()
    coded = wire.encode_events(t.log(), schema, 7).select("partition", "offset", "value")
    return wire.decode_events(coded, schema, 7)


@query("""select meter_type, cast(event_id % 2 as integer) as version, count(*) as events, cast(sum(case when event_id % 4 = 1 then 1 else 0 end) as bigint) as with_quality, sum(meter_reading) as sum_reading from telemetry group by 1, 2""")
def mixed_schemas(t: Tables) -> DataFrame:
    """Records of two versions of the schema in one log, each read with its own and resolved to the newer one."""
    old, new = _valid_schema(), avro_schema(2)
    new["fields"][1]["type"] = {"type": "enum", "name": "MeterType", "symbols": [*DOMAIN, "later"]}
    events = t.telemetry()
    first = wire.encode_events(events.where("event_id % 2 = 0").drop("event_id"), old, 7)
    second = wire.encode_events(events.where("event_id % 2 = 1").withColumn("reading_quality", F.when(F.col("event_id") % 4 == 1, "good")).drop("event_id"), new, 8)
    log = first.select(F.lit(0).alias("partition"), "value").unionByName(second.select(F.lit(1).alias("partition"), "value"))
    read = wire.decode_events(log.repartition(4, "value"), new, 8, {7: old, 8: new})
    return read.groupBy("meter_type", F.col("partition").alias("version")).agg(F.count("*").alias("events"), F.count("reading_quality").alias("with_quality"), F.sum("meter_reading").alias("sum_reading"))


@query("""select event_id, case when fault not in (0, 4) then building_id end as building_id, case fault when 0 then null when 2 then 'gas' else meter_type end as meter_type,
    case when fault in (0, 3) then null when fault = 5 then timestamp '2099-01-01' else stamp end as "timestamp",
    case when fault in (0, 1) then null when fault = 6 then -1 - meter_reading when fault = 7 then 'NaN'::double else meter_reading end as meter_reading, case when fault > 0 then published end as sim_publish_ts from faulty""")
def parse_json(t: Tables) -> DataFrame:
    return contract.parsed(t.payloads(), keep=["event_id"])


def _checked(t: Tables) -> DataFrame:
    return contract.with_reason(t.payloads(), now=F.lit(AS_OF), domain=DOMAIN)


@query("select event_id, error from rejects where event_id % 25 in (0, 1, 2, 3, 4)")
def validate_shape(t: Tables) -> DataFrame:
    return _checked(t).where(~F.coalesce(F.col("error").rlike("future|finite|negative"), F.lit(True))).select("event_id", "error")


@query("select event_id, error from rejects where event_id % 25 in (5, 6, 7)")
def validate_domain(t: Tables) -> DataFrame:
    return _checked(t).where(F.col("error").rlike("future|finite|negative")).select("event_id", "error")


@query('select event_id, building_id, meter_type, stamp as "timestamp", meter_reading, published as sim_publish_ts from faulty where fault >= 8')
def route_valid(t: Tables) -> DataFrame:
    return contract.route_valid(t.payloads(), now=F.lit(AS_OF), domain=DOMAIN).drop("payload")


@query("select event_id, payload, error from rejects")
def route_rejected(t: Tables) -> DataFrame:
    return contract.route_rejected(t.payloads(), now=F.lit(AS_OF), domain=DOMAIN)


@query("""select event_id, '{"error":' || cast(to_json(error) as varchar) || ',"source_topic":"iot/raw","rejected_at_ms":1700000000000,"original_payload":' || cast(to_json(payload) as varchar) || '}' as value from rejects""")
def dlq_records(t: Tables) -> DataFrame:
    return contract.dead_letters(contract.route_rejected(t.payloads(), now=F.lit(AS_OF), domain=DOMAIN), F.lit("iot/raw"), F.lit(1700000000000))


_CLASS = """regexp_replace(error, '\\([^)]*\\)|''[^'']*''|"[^"]*"', '...', 'g')"""


@query(f"select event_id, {_CLASS} as reason from rejects")
def dlq_reason_class(t: Tables) -> DataFrame:
    return _checked(t).where("error is not null").select("event_id", contract.reason_class(F.col("error")).alias("reason"))


@query(f"""select reason, cast(sum(n) as bigint) as rejected from (select case when row_number() over (order by n desc, reason) <= 5 then reason else '(others)' end as reason, n
    from (select {_CLASS} as reason, count(*) as n from rejects group by 1)) group by 1""")
def dlq_breakdown(t: Tables) -> DataFrame:
    return contract.reason_breakdown(_checked(t).where("error is not null"))


@query("select distinct building_id, meter_type, building_id || ':' || meter_type as sensor, 'iot/' || building_id || '/' || meter_type || '/telemetry' as topic from telemetry")
def sensor_key(t: Tables) -> DataFrame:
    return contract.sensor_key(t.telemetry().select(*SENSOR_KEY).distinct())


@query("""select event_id, '{"building_id":"' || building_id || '","meter_type":"' || meter_type || '","timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '","meter_reading":' || cast(meter_reading as varchar)
    || ',"sim_publish_ts":' || epoch_us(sim_publish_ts) // 1000 || '}' as payload from telemetry""")
def build_payload(t: Tables) -> DataFrame:
    return t.telemetry().select("event_id", contract.build_payload(t.telemetry()).alias("payload"))


@query("""with r as (select event_id as seq, event_id % 25 as f, cast(floor(value) as double) as v from events),
    recent as (select v, row_number() over (order by v) - 1 as place, count(*) over () as n from (select v from r where f = 8 or f > 10 order by seq desc limit 10000)),
    s as (select count(*) as received, count(*) filter (where f = 8 or f > 10) as published, count(*) filter (where f < 8) as rejected, count(*) filter (where f = 9) as failures from r)
    select s.*, greatest(0, received - published - rejected) as lost, greatest(0, received - published - rejected) / received::double * 100.0::double as loss_pct,
    (select max(v) from recent where place = n // 2) as latency_p50_ms, (select max(v) from recent where place = cast(floor(n * 0.95::double) as bigint)) as latency_p95_ms, (select max(v) from recent) as latency_max_ms from s""".replace("with r as", ", r as", 1))
def ingest_stats(t: Tables) -> DataFrame:
    return contract.ingest_stats(t.received())


# --- flags, filters, joins ---------------------------------------------------
@query("select event_id, meter_reading, meter_reading = 0 as is_zero_reading from telemetry")
def zero_flag(t: Tables) -> DataFrame:
    from wattline.functions.anomaly import is_zero

    return t.telemetry().select("event_id", "meter_reading", is_zero(F.col("meter_reading")).alias("is_zero_reading"))


@query("select event_id, meter_reading, baseline_p75, baseline_iqr, is_anomaly from enriched")
def anomaly_flag(t: Tables) -> DataFrame:
    return t.enriched().select("event_id", "meter_reading", "baseline_p75", "baseline_iqr", "is_anomaly")


@query("""select factor, count(*) as events, count(*) filter (where baseline_iqr > 0 and meter_reading > baseline_p75 + factor * baseline_iqr) as anomalies,
    100.0::double * count(*) filter (where baseline_iqr > 0 and meter_reading > baseline_p75 + factor * baseline_iqr) / count(*) as anomaly_pct
    from enriched cross join (select unnest([3.0::double, 5.0::double, 10.0::double]) as factor) group by factor""")
def anomaly_threshold_sweep(t: Tables) -> DataFrame:
    return enrich.anomaly_sweep(t.telemetry(), t.baseline())


@query("select event_id, building_id, site_id is not null as in_metrics from enriched")
def orphan_split(t: Tables) -> DataFrame:
    return enrich.with_dimension(t.telemetry(), t.buildings()).select("event_id", "building_id", F.col("site_id").isNotNull().alias("in_metrics"))


@query("""select event_id, "timestamp" from telemetry where "timestamp" <= timestamp '2024-01-15 12:00:00' + interval 300 second""")
def future_guard(t: Tables) -> DataFrame:
    return metrics.not_future(t.telemetry(), now=F.lit("2024-01-15 12:00:00")).select("event_id", "timestamp")


@query("select building_id, site_id, primary_use from buildings where site_id in (2, 3, 5)")
def site_filter(t: Tables) -> DataFrame:
    return t.buildings().where(F.col("site_id").isin(2, 3, 5)).select("building_id", "site_id", "primary_use")


@query("select event_type as meter_type, count(*) as readings from events group by 1")
def decode_meter(t: Tables) -> DataFrame:
    return t.train().select(prepare.decode_meter(F.col("meter"), dict(enumerate(DOMAIN))).alias("meter_type")).groupBy("meter_type").agg(F.count("*").alias("readings"))


@query("select event_id, t.building_id, meter_reading, square_feet, meter_reading / nullif(square_feet, 0) as energy_intensity from telemetry t join buildings b on b.building_id = t.building_id")
def event_intensity(t: Tables) -> DataFrame:
    return enrich.event_intensity(t.telemetry(), t.buildings()).select("event_id", "building_id", "meter_reading", "square_feet", "energy_intensity")


@query('select event_id, building_id, meter_type, "timestamp", meter_reading, site_id, primary_use, square_feet from enriched')
def enrich_dimension(t: Tables) -> DataFrame:
    return enrich.with_dimension(t.telemetry(), t.buildings()).select("event_id", *EVENT_KEY, "meter_reading", "site_id", "primary_use", "square_feet")


@query('select event_id, building_id, meter_type, "timestamp", meter_reading, baseline_p75, baseline_iqr from enriched')
def enrich_baseline(t: Tables) -> DataFrame:
    return enrich.with_baseline(t.telemetry(), t.baseline()).select("event_id", *EVENT_KEY, "meter_reading", "baseline_p75", "baseline_iqr")


@query("select count(*) as orphan_events, count(distinct building_id) as orphan_buildings from enriched where site_id is null")
def orphan_summary(t: Tables) -> DataFrame:
    return enrich.orphan_summary(t.telemetry(), t.buildings())


@query("select building_id, count(*) as events from enriched where site_id is null group by 1 order by 2 desc, 1 limit 10")
def orphan_topk(t: Tables) -> DataFrame:
    return enrich.orphan_topk(t.telemetry(), t.buildings())


@query("""select event_id, building_id, meter_type, "timestamp", meter_reading, site_id, primary_use from enriched where site_id is not null and baseline_iqr > 0 and meter_reading > baseline_p75 + 3 * baseline_iqr""")
def star_anomaly(t: Tables) -> DataFrame:
    return enrich.star_anomalies(t.telemetry(), t.buildings(), t.baseline(), 3.0).select("event_id", *EVENT_KEY, "meter_reading", "site_id", "primary_use")


@query('select building_id, meter_type, "timestamp" as event_time, meter_reading, sim_publish_ts from telemetry')
def raw_events(t: Tables) -> DataFrame:
    return metrics.raw_events(t.telemetry())


@query("""select building_id || ':' || meter_type as "key", cast(cast('0x' || substr(md5(building_id || ':' || meter_type), 1, 6) as bigint) % 3 as integer) as "partition", count(*) as records, min(published) as first_published, max(published) as last_published
    from faulty where fault >= 8 group by 1, 2""")
def ingest_json(t: Tables) -> DataFrame:
    """Payloads all the way into the log and out of it: validated, keyed, framed, and decoded again."""
    good = contract.route_valid(t.payloads(), now=F.lit(AS_OF), domain=DOMAIN)
    read = wire.decode_events(ingest.log_rows(good, _valid_schema(), 7, 3), _valid_schema(), 7)
    return read.groupBy("key", "partition").agg(F.count("*").alias("records"), F.min("sim_publish_ts").alias("first_published"), F.max("sim_publish_ts").alias("last_published"))


# --- the log and the job over it ----------------------------------------------
#: Rows that a task sorts and writes to the log.
ROWS_PER_TASK = 200_000


def _written_log(t: Tables, commits: int = 4) -> str:
    """The events as a log, appended by several commits in the order of time."""
    path, schema = scratch(t.spark, "log"), _valid_schema()
    at = F.unix_micros("timestamp").cast("double")
    events = t.telemetry()
    tasks = max(2, 1 + events.count() // (commits * ROWS_PER_TASK))
    borders = [None, *events.withColumn("at", at).approxQuantile("at", [k / commits for k in range(1, commits)], 0.01), None]
    for n, (low, high) in enumerate(zip(borders, borders[1:])):
        part = events.where((F.lit(True) if low is None else at >= low) & (F.lit(True) if high is None else at < high))
        append_log(ingest.log_rows(part, schema, 7, 3), path, tasks, "query", n)
    return path


@query("""select "partition", count(*) as records, cast(0 as bigint) as first_offset, count(*) - 1 as last_offset, count(*) as distinct_offsets, count(distinct "key") as sensors, cast(0 as bigint) as out_of_order, sum(meter_reading) as sum_reading from log group by 1""")
def log_round_trip(t: Tables) -> DataFrame:
    """Events through the transactional log: gapless offsets, and every sensor's events in their order."""
    from pyspark.sql import Window

    read = wire.decode_events(read_log(t.spark, _written_log(t)), _valid_schema(), 7)
    before = F.lag("timestamp").over(Window.partitionBy("partition", "key").orderBy("offset"))
    return read.withColumn("late", before > F.col("timestamp")).groupBy("partition").agg(
        F.count("*").alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count_distinct("offset").alias("distinct_offsets"), F.count_distinct("key").alias("sensors"), F.count_if("late").alias("out_of_order"),
        F.sum("meter_reading").alias("sum_reading"),
    )


def _job_tables(t: Tables) -> job.Tables:
    """The tables after the whole job has read the log, a commit a batch."""
    tables = job.Tables.at(t.spark, scratch(t.spark, "tables"))
    tables.create()
    job.load_references(tables, t.buildings(), t.baseline())
    options = JobOptions(trigger=None, checkpoint_dir=scratch(t.spark, "job"), supervise_every_s=0.2, max_per_trigger=1)
    if job.run_job(t.spark, log_source(t.spark, _written_log(t), options), tables, _valid_schema(), 7, options):
        raise RuntimeError("a query of the job was given up")
    return tables


@query("""select window_start, window_end, site_id, primary_use, meter_type, event_count, sum_reading from metrics where window_end <= (select date_trunc('milliseconds', max("timestamp")) - interval 2 minute from enriched where site_id is not null)""")
def streamed_windows(t: Tables) -> DataFrame:
    """The metrics table after the whole job has read the log, a commit a batch: every closed window with all of its events.

    Events of unknown buildings do not move the watermark.
    """
    return _job_tables(t).metrics.read().select("window_start", "window_end", "site_id", "primary_use", "meter_type", "event_count", "sum_reading")


@query("""select building_id, meter_type, date_trunc('milliseconds', "timestamp") as event_time, meter_reading, date_trunc('milliseconds', sim_publish_ts) as sim_publish_ts from telemetry
    qualify row_number() over (partition by building_id, meter_type, date_trunc('milliseconds', "timestamp") order by sim_publish_ts desc, meter_reading desc) = 1""")
def streamed_events(t: Tables) -> DataFrame:
    """The events table after the whole job."""
    return _job_tables(t).events.read().drop("ingested_at")


@query("""select query_name, cast(4 as bigint) as batches, (select count(*) from telemetry) as input_rows from (values ('events'), ('metrics')) as q(query_name)""")
def streamed_progress(t: Tables) -> DataFrame:
    """What the progress table has after the whole job: a batch a commit in either query, with all records."""
    rows = _job_tables(t).progress.read().where("num_input_rows > 0")
    return rows.groupBy("query_name").agg(F.count("*").alias("batches"), F.sum("num_input_rows").alias("input_rows"))


@query(""", with_runs as (select building_id, meter_type, date_trunc('milliseconds', "timestamp") as moment, meter_reading, sum(case when meter_reading = 0 then 0 else 1 end) over (partition by building_id, meter_type order by "timestamp") as run from telemetry),
    ends as (select building_id, meter_type, run, min(moment) as first_other from with_runs where meter_reading <> 0 group by all),
    found as (select building_id, meter_type, run, min(moment) as run_start, max(moment) as run_end, count(*) as readings from with_runs where meter_reading = 0 group by all having count(*) >= 2)
    select f.building_id, f.meter_type, run_start, run_end, readings from found f join ends e on e.building_id = f.building_id and e.meter_type = f.meter_type and e.run = f.run + 1
    where first_other < (select date_trunc('milliseconds', max("timestamp")) - interval 2 minute from telemetry)""")
def streamed_zero_runs(t: Tables) -> DataFrame:
    """Runs of zeros out of keyed state, over the log as a stream: those that another reading has ended before the watermark."""
    out, options = scratch(t.spark, "runs"), JobOptions(checkpoint_dir=scratch(t.spark, "state"), max_per_trigger=1)
    live = wire.decode_events(log_source(t.spark, _written_log(t), options)("runs"), _valid_schema(), 7)
    found = zero_runs_stream(live, idle_s=400 * 86_400.0)
    query = found.writeStream.option("checkpointLocation", f"{options.checkpoint_dir}/runs").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return t.spark.read.schema(FOUND).parquet(f"{out}/*")


# --- metrics -----------------------------------------------------------------
@query("select * exclude (ingested_at) from metrics")
def windowed_metrics(t: Tables) -> DataFrame:
    return metrics.windowed_metrics(t.enriched(), now=F.lit(AS_OF))


@query("""select window_start, window_end, site_id, primary_use, meter_type, event_count, sum_reading from metrics where window_end <= (select date_trunc('milliseconds', max("timestamp")) - interval 2 minute from telemetry)""")
def closed_windows(t: Tables) -> DataFrame:
    found = metrics.windowed_metrics(t.enriched(), now=F.lit(AS_OF))
    last = F.broadcast(t.telemetry().agg(F.max("timestamp").alias("last")))  # one row
    return metrics.closed_windows(found.join(last), F.col("last")).select("window_start", "window_end", "site_id", "primary_use", "meter_type", "event_count", "sum_reading")


@query("""select date_trunc('day', "timestamp") as window_start, meter_type, count(distinct building_id) as buildings from telemetry group by 1, 2""")
def distinct_exact(t: Tables) -> DataFrame:
    return metrics.distinct_buildings(t.telemetry())


@query("""select date_trunc('day', "timestamp") as window_start, meter_type, true as within_bounds from telemetry group by 1, 2""")
def distinct_approx(t: Tables) -> DataFrame:
    """Approximate counts held against exact ones: within three standard errors of the sketch, or one building."""
    both = metrics.distinct_buildings(t.telemetry(), approximate=True).withColumnRenamed("buildings", "about").join(metrics.distinct_buildings(t.telemetry()), ["window_start", "meter_type"])
    return both.select("window_start", "meter_type", (F.abs(F.col("about") - F.col("buildings")) <= F.greatest(F.lit(1.0), 3 * 0.05 * F.col("buildings"))).alias("within_bounds"))


@query("""select date_trunc('day', window_start) as window_start, date_trunc('day', window_start) + interval 1 day as window_end, meter_type, cast(sum(event_count) as bigint) as event_count, max(max_reading) as max_reading, sum(sum_reading) as sum_reading,
    sum(sum_square_feet) as sum_square_feet, cast(sum(zero_count) as bigint) as zero_count, cast(sum(anomaly_count) as bigint) as anomaly_count, max(max_sim_publish_ts) as max_sim_publish_ts,
    sum(sum_reading) / sum(event_count) as avg_reading, case when sum(sum_square_feet) > 0 then sum(sum_reading) / sum(sum_square_feet) end as avg_energy_intensity from metrics group by all""")
def coarser_metrics(t: Tables) -> DataFrame:
    return metrics.coarser_metrics(t.metrics())


@query("""select building_id, meter_type, min("timestamp") as run_start, max("timestamp") as run_end, count(*) as readings from (select *, sum(case when meter_reading = 0 then 0 else 1 end) over (partition by building_id, meter_type order by "timestamp") as run from telemetry)
    where meter_reading = 0 group by building_id, meter_type, run having count(*) >= 2""")
def zero_runs(t: Tables) -> DataFrame:
    return metrics.zero_runs(t.telemetry())


@query("""select date_trunc('day', "timestamp") as window_start, meter_type, count(*) as event_count, true as distinct_within, true as ranks_within from enriched where site_id is not null group by 1, 2""")
def sketched_days(t: Tables) -> DataFrame:
    """Days merged from the sketches of hours, held against the events: distinct buildings within three standard errors, quartiles within the sketch's rank error."""
    sketches = metrics.sketch_estimates(metrics.coarser_sketches(metrics.window_sketches(t.enriched(), now=F.lit(AS_OF))))
    events = t.enriched().where("site_id is not null").select(F.date_trunc("day", "timestamp").alias("window_start"), "meter_type", "building_id", "meter_reading")
    names = {"reading_p25": 0.25, "reading_p50": 0.5, "reading_p75": 0.75}
    told = events.join(sketches, ["window_start", "meter_type"]).groupBy("window_start", "meter_type", "event_count", "distinct_buildings", *names).agg(
        F.count_distinct("building_id").alias("exact"), F.count("*").alias("n"), *[F.count_if(F.col("meter_reading") < F.col(x)).alias(f"below_{x}") for x in names], *[F.count_if(F.col("meter_reading") <= F.col(x)).alias(f"upto_{x}") for x in names],
    )
    distinct = F.abs(F.col("distinct_buildings") - F.col("exact")) <= F.greatest(F.lit(1.0), 3 * metrics.HLL_ERROR * F.col("exact"))
    inside = [(F.col(f"below_{x}") <= (p + KLL_ERROR) * F.col("n") + 1) & (F.col(f"upto_{x}") >= (p - KLL_ERROR) * F.col("n") - 1) for x, p in names.items()]
    return told.select("window_start", "meter_type", "event_count", distinct.alias("distinct_within"), reduce(lambda a, b: a & b, inside).alias("ranks_within"))


def _holds_rank(value: str, estimate: str, share: float):
    """An aggregate: is the estimate's rank among the values within the sketch's error of the share, or one value of it."""
    n = F.count(value)
    return (F.count_if(F.col(value) < F.col(estimate)) <= (share + KLL_ERROR) * n + 1) & (F.count_if(F.col(value) <= F.col(estimate)) >= (share - KLL_ERROR) * n - 1)


@query("select building_id, meter_type, count(*) as readings, true as ranks_within from telemetry group by 1, 2")
def sketched_baseline(t: Tables) -> DataFrame:
    """Baselines merged from sketches of days, held against the sensors' readings."""
    found = prepare.sketched_baseline(prepare.sensor_sketches(t.telemetry()))
    both = t.telemetry().join(found, SENSOR_KEY)
    inside = reduce(lambda a, b: a & b, [_holds_rank("meter_reading", f"baseline_p{n}", n / 100) for n in (25, 50, 75)])
    return both.groupBy(*SENSOR_KEY).agg(F.count("*").alias("readings"), inside.alias("ranks_within"))


@query("select count(*) as events, count(*) as measured, max(epoch_us(ingested_at) - epoch_us(sim_publish_ts)) / 1e6::double as latency_max_s, cast(0 as bigint) as negative, true as ranks_within from telemetry")
def kpi_latency_sketched(t: Tables) -> DataFrame:
    """Ingest latency in one pass, held against the events."""
    found = kpi.sketched_latency(t.telemetry())
    s = (F.unix_micros("ingested_at") - F.unix_micros("sim_publish_ts")) / F.lit(1e6)
    both = t.telemetry().select(s.alias("s")).join(F.broadcast(found))  # one row
    inside = _holds_rank("s", "latency_p50_s", 0.5) & _holds_rank("s", "latency_p95_s", 0.95)
    return both.groupBy("events", "measured", "latency_max_s", "negative").agg(inside.alias("ranks_within"))


# --- keys --------------------------------------------------------------------
@query("""select building_id, meter_type, "timestamp", meter_reading, sim_publish_ts, seq from deliveries qualify row_number() over (partition by building_id, meter_type, "timestamp" order by seq desc) = 1""")
def dedup_last(t: Tables) -> DataFrame:
    return dedup.dedup_last(t.deliveries(), EVENT_KEY, ["seq"])


@query("""select building_id, meter_type, "timestamp", count(*) as copies, count(distinct meter_reading) as variants from deliveries group by 1, 2, 3 having count(distinct meter_reading) > 1""")
def key_collisions(t: Tables) -> DataFrame:
    return dedup.key_collisions(t.deliveries().drop("seq"), EVENT_KEY)


@query("""select building_id, meter_type, "timestamp", case when meter_type = 'view' then meter_reading + 10 else meter_reading end as meter_reading, case when meter_type = 'view' then sim_publish_ts + to_milliseconds(5000) else sim_publish_ts end as sim_publish_ts from telemetry
    union all select building_id, meter_type, "timestamp" + interval 8784 hour, meter_reading, sim_publish_ts from telemetry where meter_type = 'click'""")
def upsert_merge(t: Tables) -> DataFrame:
    old = t.telemetry().select(*EVENT_KEY, "meter_reading", "sim_publish_ts")
    changed = old.where("meter_type = 'view'")
    later = changed.withColumns({"meter_reading": F.col("meter_reading") + 10, "sim_publish_ts": F.col("sim_publish_ts") + F.expr("interval 5 seconds")})
    added = old.where("meter_type = 'click'").withColumn("timestamp", F.col("timestamp") + F.expr("interval 8784 hours"))
    return dedup.upsert_merge(old, changed.unionByName(later).unionByName(added), EVENT_KEY, ["sim_publish_ts"])


@query(ORACLES["upsert_merge"].removeprefix(_WITH))
def keyed_runs(t: Tables) -> DataFrame:
    """The same merges, one by one into a table that is merged on reading."""
    rows = t.telemetry().select(*EVENT_KEY, "meter_reading", "sim_publish_ts")
    table = KeyedTable(t.spark, scratch(t.spark, "keyed"), rows.schema, EVENT_KEY, ["sim_publish_ts"], "timestamp", fan=4)
    changed = rows.where("meter_type = 'view'")
    later = changed.withColumns({"meter_reading": F.col("meter_reading") + 10, "sim_publish_ts": F.col("sim_publish_ts") + F.expr("interval 5 seconds")})
    for batch in (rows, changed, later, rows.where("meter_type = 'click'").withColumn("timestamp", F.col("timestamp") + F.expr("interval 8784 hours")), later):
        table.upsert(batch)
    return table.read()


@query("select building_id, cast(site_id as integer) as site_id, primary_use, square_feet + case when site_id in (2, 3, 5) then 1 else 0 end as square_feet from buildings")
def upsert_reference(t: Tables) -> DataFrame:
    old = t.buildings().select("building_id", "site_id", "primary_use", "square_feet")
    return dedup.upsert_merge(old, old.where(F.col("site_id").isin(2, 3, 5)).withColumn("square_feet", F.col("square_feet") + 1), ["building_id"], ["square_feet"])


@query("select trigger_ts, run_id, query_name, batch_id, num_input_rows, duration_ms from progress")
def insert_ignore(t: Tables) -> DataFrame:
    p = t.progress().drop("processed_rows_per_second")
    again = p.withColumn("duration_ms", F.col("duration_ms") + 1)
    return dedup.insert_ignore(p.where("run_id = 'run1'"), p.where("run_id = 'run2'").unionByName(again), PROGRESS_KEY, ["duration_ms"])


@query("""select building_id, meter_type, case when meter_type <> 'error' then "timestamp" end as "timestamp", max(meter_reading) as meter_reading from telemetry group by 1, 2, 3""")
def replay_null_keys(t: Tables) -> DataFrame:
    """A batch with nulls in its keys, merged three times: null is a key like any other."""
    rows = t.telemetry().select(*SENSOR_KEY, F.when(F.col("meter_type") != "error", F.col("timestamp")).alias("timestamp"), "meter_reading")
    table = rows.limit(0)
    for _ in range(3):
        table = dedup.upsert_merge(table, rows, EVENT_KEY, ["meter_reading"])
    return table


@query("""select building_id, meter_type, "timestamp", meter_reading, sim_publish_ts, seq from deliveries qualify row_number() over (partition by building_id, meter_type, "timestamp" order by seq desc) = 1""")
def replay_idempotent(t: Tables) -> DataFrame:
    once = dedup.upsert_merge(t.deliveries().limit(0), t.deliveries(), EVENT_KEY, ["seq"])
    return dedup.upsert_merge(once, t.deliveries(), EVENT_KEY, ["seq"])


# --- replay ------------------------------------------------------------------
_FIRST = "select distinct building_id, meter_type from telemetry order by 1, 2 limit 20"


@query('select building_id, meter_type, "timestamp", meter_reading from telemetry order by "timestamp", building_id, meter_type')
def replay_order(t: Tables) -> DataFrame:
    return replay.replay_order(t.telemetry().select(*EVENT_KEY, "meter_reading"))


@query('select building_id, meter_type, "timestamp", meter_reading from telemetry order by "timestamp", building_id, meter_type limit 500')
def replay_prefix(t: Tables) -> DataFrame:
    return replay.replay_prefix(t.telemetry().select(*EVENT_KEY, "meter_reading"), 500)


@query(f'select building_id, meter_type, "timestamp", meter_reading from telemetry semi join ({_FIRST}) using (building_id, meter_type)')
def sensor_subset(t: Tables) -> DataFrame:
    return replay.sensor_subset(t.telemetry().select(*EVENT_KEY, "meter_reading"), 20)


@query("""select building_id, meter_type, "timestamp" + (timestamp '2025-01-01' - (select max("timestamp") from telemetry)) as "timestamp", meter_reading from telemetry""")
def replay_rebase(t: Tables) -> DataFrame:
    return replay.rebase(t.telemetry().select(*EVENT_KEY, "meter_reading"), F.lit("2025-01-01 00:00:00"))


@query(f""", p as (select building_id, meter_type, "timestamp", meter_reading from telemetry semi join ({_FIRST}) using (building_id, meter_type) order by 3, 1, 2 limit 100)
    select building_id, meter_type, "timestamp" + (timestamp '2025-01-01' - (select max("timestamp") from p)) as "timestamp", meter_reading from p""")
def replay_prepare(t: Tables) -> DataFrame:
    return replay.replay_prepare(t.telemetry().select(*EVENT_KEY, "meter_reading"), 20, 100, F.lit("2025-01-01 00:00:00"))


_SCHEDULE = """, s as (select building_id, meter_type, row_number() over (order by building_id, meter_type) - 1 as sensor_rank from (select distinct building_id, meter_type from telemetry)),
    plan as (select building_id, meter_type, "timestamp", sensor_rank, sensor_rank % 4 as connection,
    (epoch_us("timestamp") - (select min(epoch_us("timestamp")) from telemetry)) / 1e6::double / 2000.0::double + sensor_rank::double / (select count(*) from s)::double * 3600.0::double / 2000.0::double as offset_s from telemetry join s using (building_id, meter_type))"""


@query(f"{_SCHEDULE} select * from plan")
def replay_schedule(t: Tables) -> DataFrame:
    return replay.replay_schedule(t.telemetry(), 2000.0, 4)


@query(f"{_SCHEDULE} select connection, count(*) as events, count(distinct sensor_rank) as sensors, max(offset_s) as last_offset_s from plan group by 1")
def replay_partition(t: Tables) -> DataFrame:
    plan = replay.agendas(replay.replay_schedule(t.telemetry(), 2000.0, 4), 4)
    return plan.groupBy("connection").agg(F.count("*").alias("events"), F.countDistinct("sensor_rank").alias("sensors"), F.max("offset_s").alias("last_offset_s"))


@query("select count(distinct (building_id, meter_type)) * 2000.0::double / 3600.0::double as events_per_second, count(distinct (building_id, meter_type)) as sensors from telemetry")
def theoretical_rate(t: Tables) -> DataFrame:
    return replay.theoretical_rate(t.telemetry(), 2000.0)


# --- preparation -------------------------------------------------------------
@query('select t.building_id, meter_type, "timestamp", meter_reading from telemetry t join buildings b on b.building_id = t.building_id where site_id in (2, 3, 5)')
def prepare_telemetry(t: Tables) -> DataFrame:
    return prepare.prepare(t.train(), t.metadata(), [2, 3, 5], dict(enumerate(DOMAIN)))[0]


@query("select building_id, site_id, primary_use, square_feet, year_built, floor_count from buildings where site_id in (2, 3, 5)")
def prepare_buildings(t: Tables) -> DataFrame:
    return prepare.prepare(t.train(), t.metadata(), [2, 3, 5], dict(enumerate(DOMAIN)))[1]


@query("select l.* from baseline l join buildings b on b.building_id = l.building_id where site_id in (2, 3, 5)")
def prepare_baseline(t: Tables) -> DataFrame:
    return prepare.prepare(t.train(), t.metadata(), [2, 3, 5], dict(enumerate(DOMAIN)))[2]


# --- indicators --------------------------------------------------------------
_S = "epoch_us(ingested_at) - epoch_us(sim_publish_ts)"


@query(f"""select count(*) as events, count(s) as measured, quantile_cont(s, 0.5) as latency_p50_s, quantile_cont(s, 0.95) as latency_p95_s, max(s) as latency_max_s, count(*) filter (where s < 0) as negative from (select ({_S}) / 1e6::double as s from telemetry)""")
def kpi_ingest_latency(t: Tables) -> DataFrame:
    return kpi.ingest_latency(t.telemetry())


@query("""select count(*) as windows, quantile_cont(s, 0.5) as latency_p50_s, quantile_cont(s, 0.95) as latency_p95_s from (select (epoch_us(ingested_at) - epoch_us(max_sim_publish_ts)) / 1e6::double as s from metrics)""")
def kpi_aggregate_latency(t: Tables) -> DataFrame:
    return kpi.aggregate_latency(t.metrics())


@query("""select query_name, count(*) as batches, quantile_cont(duration_ms::double, 0.5) as duration_p50_ms, quantile_cont(duration_ms::double, 0.95) as duration_p95_ms, max(duration_ms) as duration_max_ms, cast(sum(num_input_rows) as bigint) as input_rows,
    round(avg(processed_rows_per_second) filter (where num_input_rows > 0), 6) as mean_rate from progress where run_id = (select max(run_id) from progress) group by 1""")
def kpi_microbatch(t: Tables) -> DataFrame:
    return kpi.microbatches(t.progress()).withColumn("mean_rate", F.round("mean_rate", 6))


@query("select count(*) filter (where fault >= 8) as valid, count(*) filter (where fault < 8) as rejected, 100.0::double * count(*) filter (where fault >= 8) / count(*) as valid_pct from faulty")
def kpi_validation(t: Tables) -> DataFrame:
    checked = _checked(t)
    return kpi.validation(checked.where("error is null"), checked.where("error is not null"))


@query(f"select count(*) as events, quantile_cont(s, 0.5) as latency_p50_s, quantile_cont(s, 0.95) as latency_p95_s from (select ({_S}) / 1e6::double as s from telemetry where ingested_at >= timestamp '2024-01-15')")
def kpi_latency_since(t: Tables) -> DataFrame:
    return kpi.latency_since(t.telemetry(), "2024-01-15 00:00:00")


@query("""select count(*) as events, (max(epoch_us(sim_publish_ts)) - min(epoch_us(sim_publish_ts))) / 1e6::double as span_s, count(*) / nullif((max(epoch_us(sim_publish_ts)) - min(epoch_us(sim_publish_ts))) / 1e6::double, 0) as events_per_second
    from telemetry where ingested_at >= timestamp '2024-01-15'""")
def publish_rate(t: Tables) -> DataFrame:
    return kpi.publish_rate(t.telemetry(), "2024-01-15 00:00:00")


@query("""select trigger_ts, run_id, query_name, batch_id, num_input_rows, processed_rows_per_second, duration_ms from progress""")
def progress_rows(t: Tables) -> DataFrame:
    """Micro-batch reports as rows of the progress table, from reports in the form in which Spark hands them over."""
    reports = t.progress().withColumn("report", F.to_json(F.struct(
        F.date_format("trigger_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("query_name").alias("name"), F.col("batch_id").alias("batchId"), F.col("num_input_rows").alias("numInputRows"),
        F.col("processed_rows_per_second").alias("processedRowsPerSecond"), F.struct(F.col("duration_ms").alias("triggerExecution")).alias("durationMs"),
    )))
    return kpi.progress_of(reports.select("run_id", "report")).select("trigger_ts", "run_id", "query_name", "batch_id", "num_input_rows", "processed_rows_per_second", "duration_ms")


@query("select query_name, quantile_cont(duration_ms::double, 0.95) as duration_p95_ms from progress where trigger_ts >= timestamp '2024-01-15' and num_input_rows > 0 group by 1")
def microbatch_p95_since(t: Tables) -> DataFrame:
    return kpi.microbatch_p95_since(t.progress(), "2024-01-15 00:00:00")


@query("""select largest_rate, base_rate, (base_rate - largest_rate) * 100.0::double / nullif(base_rate, 0) as degradation_pct from (select arg_max(published_rate, sensors) filter (where not hot_base) as largest_rate, max(published_rate) filter (where hot_base) as base_rate from rungs)""")
def ladder_degradation(t: Tables) -> DataFrame:
    return kpi.ladder_degradation(t.rungs())


@query("""select label, requested_rate, published_rate, latency_p95_s, coalesce(latency_p95_s > 3 * lag(latency_p95_s) over (order by requested_rate, label), false) as is_knee, published_rate < requested_rate * 0.95::double as producer_ceiling from rungs""")
def ladder_knee(t: Tables) -> DataFrame:
    return kpi.ladder_knee(t.rungs())


# --- panels ------------------------------------------------------------------
VIEW = View(start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", bucket="6 hours", meter_type="view", as_of=AS_OF)
_IN = "window_start >= timestamp '2024-01-05' and window_start <= timestamp '2024-01-25'"
_M = f"{_IN} and meter_type = 'view'"
_T = "time_bucket(interval 6 hour, window_start, timestamp '2024-01-01') as \"time\""
_LAT = "(epoch_us(ingested_at) - epoch_us(max_sim_publish_ts)) / 1e6::double"
_H = "(select window_start, sum({}) as total from metrics where " + _M + " group by 1)"
PANEL_SQL = {
    "latency_p95": f"select quantile_cont({_LAT}, 0.95) as latency_p95_s from metrics where {_IN}",
    "data_age": f"select (epoch_us(timestamp '{AS_OF}') - max(epoch_us(ingested_at))) / 1e6::double as age_s from metrics",
    "events": f"select cast(sum(event_count) as bigint) as events from metrics where {_IN}",
    "windows": f"select count(*) as windows from metrics where {_IN}",
    "latency_series": f"select {_T}, quantile_cont({_LAT}, 0.5) as p50_s, quantile_cont({_LAT}, 0.95) as p95_s from metrics where {_IN} group by 1",
    "write_rate": f"select {_T}, cast(sum(event_count) as bigint) as events, count(*) as windows from metrics where {_IN} group by 1",
    "meter_types": "select distinct meter_type from metrics",
    "peak": f"select max(total) as peak_demand from {_H.format('sum_reading')}",
    "base": f"select min(total) as base_load from {_H.format('sum_reading')}",
    "load_factor": f"select avg(total) / nullif(max(total), 0) as load_factor from {_H.format('sum_reading')}",
    "buildings": f"select cast(max(total) as bigint) as buildings_reporting from {_H.format('distinct_buildings')}",
    "consumption": f"select {_T}, meter_type, sum(sum_reading) as consumption from metrics where {_IN} group by 1, 2",
    "load_profile": f"select cast(hour(window_start) as integer) as hour_of_day, sum(sum_reading) as consumption from metrics where {_M} group by 1",
    "intensity": f"select primary_use, sum(sum_reading) / nullif(sum(sum_square_feet), 0) as intensity from metrics where {_M} group by 1",
    "site": f"select {_T}, 'site ' || site_id as site, sum(sum_reading) as consumption from metrics where {_M} group by 1, 2",
    "pct_zero": f"select 100.0::double * sum(zero_count) / nullif(sum(event_count), 0) as zero_pct from metrics where {_IN}",
    "pct_anomaly": f"select 100.0::double * sum(anomaly_count) / nullif(sum(event_count), 0) as anomaly_pct from metrics where {_IN}",
    "pct_valid": f"select 100.0::double * (sum(event_count) - sum(zero_count) - sum(anomaly_count)) / nullif(sum(event_count), 0) as valid_pct from metrics where {_IN}",
    "quality_series": f"select {_T}, cast(sum(zero_count) as bigint) as zeros, cast(sum(anomaly_count) as bigint) as anomalies from metrics where {_IN} group by 1",
    "zero_groups": f"""select site_id, primary_use, meter_type, cast(sum(zero_count) as bigint) as zeros, round(100.0::double * sum(zero_count) / nullif(sum(event_count), 0), 1) as zero_pct from metrics where {_IN}
        group by 1, 2, 3 having sum(zero_count) > 0 order by zeros desc, 1, 2, 3 limit 15""",
    "recent_anomalies": f"""select window_start, site_id, primary_use, meter_type, anomaly_count, event_count, round(max_reading, 1) as max_reading from metrics where {_IN} and anomaly_count > 0
        order by window_start desc, anomaly_count desc, site_id, primary_use, meter_type limit 50""",
}
for _name, _panel in PANELS.items():
    query(PANEL_SQL[_name.removeprefix("panel_")], name=_name)(lambda t, f=_panel: f(t.metrics(), VIEW))



# --- panels over roll-ups ------------------------------------------------------
def _rolled(t: Tables) -> Rollups:
    """Roll-ups of the metrics, brought up to date by three batches."""
    table = KeyedTable(t.spark, scratch(t.spark, "hourly"), T.StructType([*METRICS.fields, T.StructField("ingested_at", T.TimestampType())]), METRIC_KEY, ["ingested_at"], "window_start")
    found = Rollups(t.spark, scratch(t.spark, "rollups"), table)
    rows = t.metrics().select(*table.schema.names).persist()
    for n in range(3):
        batch = rows.where(F.pmod(F.xxhash64(*METRIC_KEY), F.lit(3)) == n)
        table.upsert(batch)
        found.follow(batch, n)
    rows.unpersist()
    return found


for _name in ("consumption", "write_rate", "pct_valid", "zero_groups"):
    query(PANEL_SQL[_name], name=f"rolled_{_name}")(lambda t, n=f"panel_{_name}": routed(_rolled(t), n, VIEW))

__all__ = ["ORACLES", "QUERIES"]
