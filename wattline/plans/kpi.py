"""Performance indicators of a run, and the report over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.anomaly import ratio
from wattline.functions.quantiles import exact_percentiles, sketched_percentile, value_sketch
from wattline.functions.time import in_range, seconds

TARGETS = {"latency_p95_s": 2.0, "loss_pct": 0.1, "valid_pct": 100.0, "batch_p95_ms": 3000.0, "rate": 50.0, "panel_s": 5.0, "degradation_pct": 20.0, "recovery_s": 60.0}


def _latency(publish: str = "sim_publish_ts") -> Column:
    return seconds(F.col("ingested_at"), F.col(publish))


#: Latencies are sorted into cells of a millisecond first.
_SHARES, _CELL_S = {"latency_p50_s": 0.5, "latency_p95_s": 0.95}, 0.001


def ingest_latency(events: DataFrame) -> DataFrame:
    """Rows, median, 95th percentile and maximum of ingest less publish time, and how many are negative."""
    x = events.select(_latency().alias("s"))
    # Two passes over the events: a histogram with all totals, and the values of the few cells that hold the percentiles.
    also = {"events": (F.count("*"), F.sum("events")), "measured": (F.count("x"), F.sum("measured")), "latency_max_s": (F.max("x"), F.max("latency_max_s")), "negative": (F.count_if(F.col("x") < 0), F.sum("negative"))}
    found = exact_percentiles(x, F.col("s"), _SHARES, _CELL_S, also)
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("events", "measured")]
    return found.select(*counts, *_SHARES, "latency_max_s", F.coalesce("negative", F.lit(0)).cast("long").alias("negative"))


def sketched_latency(events: DataFrame) -> DataFrame:
    """``ingest_latency`` in one pass over the events: percentiles are within the rank error of a sketch."""
    x = events.select(_latency().alias("s"))
    one = x.agg(F.count("*").alias("events"), F.count("s").alias("measured"), value_sketch(F.col("s")).alias("sketch"), F.max("s").alias("latency_max_s"), F.count_if(F.col("s") < 0).alias("negative"))
    return one.select("events", "measured", *[F.when(F.col("measured") > 0, sketched_percentile(F.col("sketch"), p)).alias(name) for name, p in _SHARES.items()], "latency_max_s", "negative")


def aggregate_latency(metrics: DataFrame) -> DataFrame:
    x = metrics.where("max_sim_publish_ts is not null").select(_latency("max_sim_publish_ts").alias("s"))
    found = exact_percentiles(x, F.col("s"), _SHARES, _CELL_S, {"windows": (F.count("*"), F.sum("windows"))})
    return found.select(F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), *_SHARES)


def microbatches(progress: DataFrame, run_id: str | None = None) -> DataFrame:
    """Batches, duration percentiles, rows and mean rate of non-empty batches of each query; by default of the last run."""
    if run_id is None:
        last = F.broadcast(progress.agg(F.max("run_id").alias("run_id")))  # one row
        rows = progress.join(last, "run_id", "left_semi")
    else:
        rows = progress.where(F.col("run_id") == run_id)
    return rows.groupBy("query_name").agg(
        F.count("*").alias("batches"), F.percentile("duration_ms", 0.5).alias("duration_p50_ms"), F.percentile("duration_ms", 0.95).alias("duration_p95_ms"), F.max("duration_ms").alias("duration_max_ms"),
        F.sum("num_input_rows").alias("input_rows"), F.avg(F.when(F.col("num_input_rows") > 0, F.col("processed_rows_per_second"))).alias("mean_rate"),
    )


def validation(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """Valid and rejected payloads, and the share of valid ones; null without any."""
    both = valid.agg(F.count("*").alias("valid")).join(rejected.agg(F.count("*").alias("rejected")))
    return both.withColumn("valid_pct", ratio(F.lit(100.0) * F.col("valid"), F.col("valid") + F.col("rejected")))


def latency_since(events: DataFrame, since: str) -> DataFrame:
    x = events.where(F.col("ingested_at") >= F.lit(since).cast("timestamp")).select(_latency().alias("s"))
    found = exact_percentiles(x, F.col("s"), _SHARES, _CELL_S, {"events": (F.count("*"), F.sum("events"))})
    return found.select(F.coalesce("events", F.lit(0)).cast("long").alias("events"), *_SHARES)


def publish_rate(events: DataFrame, since: str | None = None) -> DataFrame:
    """Events a second between the first and the last publish time; null if these are one."""
    kept = events.where(in_range(F.col("ingested_at"), since, None))
    return kept.agg(F.count("*").alias("events"), seconds(F.max("sim_publish_ts"), F.min("sim_publish_ts")).alias("span_s")).withColumn("events_per_second", ratio(F.col("events"), F.col("span_s")))


def microbatch_p95_since(progress: DataFrame, since: str) -> DataFrame:
    kept = progress.where((F.col("trigger_ts") >= F.lit(since).cast("timestamp")) & (F.col("num_input_rows") > 0))
    return kept.groupBy("query_name").agg(F.percentile("duration_ms", 0.95).alias("duration_p95_ms"))


_REPORT = """timestamp string, name string, batchId bigint, numInputRows bigint, inputRowsPerSecond double, processedRowsPerSecond double, durationMs struct<triggerExecution: bigint, addBatch: bigint, queryPlanning: bigint>,
    eventTime struct<max: string, watermark: string>, stateOperators array<struct<numRowsDroppedByWatermark: bigint>>, sources array<struct<metrics: map<string, string>>>, sink struct<numOutputRows: bigint>"""


def progress_of(reports: DataFrame) -> DataFrame:
    """Rows of the progress table out of reports kept as JSON (columns run_id, report), as a log of them holds."""
    r = reports.select("run_id", F.from_json("report", _REPORT).alias("r"))
    moment = lambda c: F.when(~c.startswith("1970-01-01T00:00:00"), c).try_cast("timestamp")
    return r.select(
        moment(F.col("r.timestamp")).alias("trigger_ts"), "run_id", F.col("r.name").alias("query_name"), F.col("r.batchId").alias("batch_id"), F.col("r.numInputRows").alias("num_input_rows"),
        F.coalesce("r.inputRowsPerSecond", F.lit(0.0)).alias("input_rows_per_second"), F.coalesce("r.processedRowsPerSecond", F.lit(0.0)).alias("processed_rows_per_second"),
        F.col("r.durationMs.triggerExecution").alias("duration_ms"), F.col("r.durationMs.addBatch").alias("add_batch_ms"), F.col("r.durationMs.queryPlanning").alias("query_planning_ms"), F.col("r.sink.numOutputRows").alias("sink_num_output_rows"),
        F.when(F.size("r.stateOperators") > 0, F.aggregate("r.stateOperators", F.lit(0).cast("bigint"), lambda a, x: a + x["numRowsDroppedByWatermark"])).alias("rows_dropped_by_watermark"),
        F.try_element_at(F.try_element_at("r.sources", F.lit(1))["metrics"], F.lit("maxOffsetsBehindLatest")).cast("double").cast("bigint").alias("offsets_behind"),
        moment(F.col("r.eventTime.max")).alias("event_time_max"), moment(F.col("r.eventTime.watermark")).alias("watermark"),
    )


def ladder_degradation(rungs: DataFrame) -> DataFrame:
    """How much slower the largest rung is than the base rung repeated hot, in percent of the latter."""
    one = rungs.agg(F.max_by("published_rate", F.when(~F.col("hot_base"), F.col("sensors"))).alias("largest_rate"), F.max(F.when(F.col("hot_base"), F.col("published_rate"))).alias("base_rate"))
    return one.withColumn("degradation_pct", ratio((F.col("base_rate") - F.col("largest_rate")) * 100.0, F.col("base_rate")))


def ladder_knee(rungs: DataFrame, factor: float = 3.0, ceiling: float = 0.95) -> DataFrame:
    """Rungs by load, where latency leaps over that of the previous one, and where the producer falls behind."""
    before = F.lag("latency_p95_s").over(Window.orderBy("requested_rate", "label"))
    knee = F.coalesce(F.col("latency_p95_s") > before * factor, F.lit(False))
    behind = F.col("published_rate") < F.col("requested_rate") * ceiling
    return rungs.select("label", "requested_rate", "published_rate", "latency_p95_s", knee.alias("is_knee"), behind.alias("producer_ceiling"))


def report(values: dict[str, float | None]) -> str:
    """A Markdown table of measured values against their targets; higher is better for rates and valid shares."""
    lines = ["| indicator | measured | target | met |", "|---|---|---|---|"]
    for name, target in TARGETS.items():
        value = values.get(name)
        better = name in ("rate", "valid_pct")
        met = "not measured" if value is None else "yes" if (value >= target if better else value < target) else "no"
        lines.append(f"| {name} | {'-' if value is None else f'{value:g}'} | {'>=' if better else '<'} {target:g} | {met} |")
    return "\n".join(lines) + "\n"


def measured(events: DataFrame, metrics: DataFrame, progress: DataFrame, valid: int | None = None, rejected: int | None = None, published: int | None = None, rungs: DataFrame | None = None, panel_s: float | None = None, recovery_s: float | None = None, run_id: str | None = None) -> dict[str, float | None]:
    """The indicators of a run out of its tables and counts; None for what was not observed.

    ``published`` is the number of events sent in, each of which should be in the
    events table once; panel and recovery times are measured by the caller.
    """
    first = lambda df: df.first().asDict()  # noqa: E731  one row each
    latency, rate, availability = first(ingest_latency(events)), first(publish_rate(events)), first(aggregate_latency(metrics))
    batches = {r["query_name"]: r["duration_p95_ms"] for r in microbatches(progress, run_id).collect()}
    share = None if valid is None or rejected is None or valid + rejected == 0 else 100.0 * valid / (valid + rejected)
    return {
        "latency_p50_s": latency["latency_p50_s"], "latency_p95_s": latency["latency_p95_s"], "aggregate_p95_s": availability["latency_p95_s"],
        "loss_pct": None if not published else 100.0 * max(0, published - latency["events"]) / published, "valid_pct": share,
        "batch_p95_ms": max(batches.values(), default=None), "rate": rate["events_per_second"], "panel_s": panel_s,
        "degradation_pct": None if rungs is None else first(ladder_degradation(rungs))["degradation_pct"], "recovery_s": recovery_s,
    }


def panel_times(metrics: DataFrame, view, repeats: int = 2, panels: dict[str, Callable] | None = None) -> dict[str, float]:
    """Seconds that each dashboard panel takes over a metrics table, the best of some runs; ``panels`` are those of the dashboard, or others."""
    import time

    from wattline.plans.panels import PANELS

    found = {}
    for name, panel in (panels or PANELS).items():
        times = []
        for _ in range(repeats):
            began = time.monotonic()
            panel(metrics, view).collect()  # a panel's rows are what a dashboard shows
            times.append(time.monotonic() - began)
        found[name] = min(times)
    return found
