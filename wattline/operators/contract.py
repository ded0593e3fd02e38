"""Contract validation of JSON payloads: parse, reason for rejection, routing, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.metrics import DEFAULT_MARGIN_S
from wattline.schemas import METER_TYPES

FIELDS = ["building_id", "meter_type", "timestamp", "meter_reading", "sim_publish_ts"]
NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)"
INTEGRAL = ("TINYINT", "SMALLINT", "INT", "BIGINT")


#: Payloads as meters write them: the five fields in this order, texts without escapes, plain numbers. All others take the way of any JSON.
_TEXT, _GAP = r'"[^"\\\x00-\x1f]*"', r"[ ]?"
FLAT = rf'^\{{"building_id":{_GAP}{_TEXT},{_GAP}"meter_type":{_GAP}{_TEXT},{_GAP}"timestamp":{_GAP}{_TEXT},{_GAP}"meter_reading":{_GAP}-?(0|[1-9][0-9]{{0,14}})(\.[0-9]{{1,14}})?([eE][-+]?[0-9]{{1,2}})?,{_GAP}"sim_publish_ts":{_GAP}-?(0|[1-9][0-9]{{0,17}})\}}$'
_FLAT_FIELDS = "building_id string, meter_type string, timestamp string, meter_reading double, sim_publish_ts bigint"
_FLAT_TYPES = {"building_id": "STRING", "meter_type": "STRING", "timestamp": "STRING", "meter_reading": "DOUBLE", "sim_publish_ts": "BIGINT"}


def _taken(x: Column) -> Column:
    """All that the rules look at, out of the flat fields or of a variant."""
    is_flat, flat, v = x["is_flat"], x["flat"], x["v"]
    pick = lambda kind, f: F.try_variant_get(v, f"$.{f}", kind)
    either = lambda of_flat, of_variant: F.when(is_flat, of_flat).otherwise(of_variant)
    types = [either(F.lit(kind), F.schema_of_variant(pick("variant", f))).alias(f"_type_{f}") for f, kind in _FLAT_TYPES.items()]
    texts = [either(flat[f].cast("string"), pick("string", f)).alias(f"_text_{f}") for f in FIELDS]
    is_object = either(F.lit(True), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).alias("_object")
    numbers = [("double", "meter_reading", "_number"), ("bigint", "timestamp", "_millis"), ("bigint", "sim_publish_ts", "_published")]
    return F.struct(is_object, *types, *texts, *[either(F.lit(None).cast("bigint") if f == "timestamp" else flat[f], pick(kind, f)).alias(name) for kind, f, name in numbers])


def _instant(millis: Column) -> Column:
    """The instant of a number of milliseconds; null beyond the years that timestamps are printed with."""
    return F.when(millis.between(-62135596800000, 253402300799999), F.timestamp_millis(millis))


def with_fields(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The payload's fields with their JSON types: for each field ``_type_`` and ``_text_``, then ``_when`` and ``_number``.

    A type is null where the field is missing. NaN and infinities, which JSON
    does not have, become marked strings. Each value is taken out once, in a
    projection of its own, so that the rules over them stay small. Payloads of
    the common shape (``FLAT``) are read with their declared types; a variant is
    made of the others alone.
    """
    is_flat = F.coalesce(F.col(payload).rlike(FLAT), F.lit(False))
    marked = F.regexp_replace(F.col(payload), r':\s*(NaN|[-+]?Infinity)\s*([,}])', ':"#$1"$2')
    told = df.withColumn("_flat", is_flat)
    read = F.struct(F.col("_flat").alias("is_flat"), F.when(F.col("_flat"), F.from_json(payload, _FLAT_FIELDS)).alias("flat"), F.when(~F.col("_flat"), F.try_parse_json(marked)).alias("v"))
    # A generator of one row: the optimizer cannot copy what it computes into each rule that uses it.
    taken = told.select(*df.columns, F.inline(F.transform(F.array(read), _taken)))
    text, kind = F.col("_text_timestamp"), F.col("_type_timestamp")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), text.try_cast("timestamp"))
    return taken.withColumn("_when", F.when(kind == "STRING", iso).when(kind.isin(*INTEGRAL), _instant(F.col("_millis"))))


def _fields() -> list[Column]:
    """The event's columns out of what ``with_fields`` has added."""
    reading, numeric = F.col("_text_meter_reading"), F.col("_type_meter_reading").rlike(NUMERIC)
    return [
        F.when(F.col("_type_building_id") == "STRING", F.col("_text_building_id")).alias("building_id"),
        F.when(F.col("_type_meter_type") == "STRING", F.col("_text_meter_type")).alias("meter_type"),
        F.col("_when").alias("timestamp"),
        F.when(numeric, F.col("_number")).when(reading.startswith("#"), F.substring(reading, 2, 20).try_cast("double")).alias("meter_reading"),
        F.when(F.col("_type_sim_publish_ts").isin(*INTEGRAL), _instant(F.col("_published"))).alias("sim_publish_ts"),
    ]


def parsed(df: DataFrame, payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Payloads as events: text id, type, instant, reading, publish time; null where a field does not parse.

    ISO-8601 times without a zone are UTC; nothing is defaulted or repaired.
    """
    kept = [c for c in df.columns if keep is None or c in keep]
    return with_fields(df, payload).select(*kept, *_fields())


def _reason(now: Column | None = None, margin_s: float = DEFAULT_MARGIN_S, domain: list[str] | None = None) -> Column:
    """Why a payload is rejected, null if it is valid, out of what ``with_fields`` has added; the first failure counts.

    In order: not a JSON object; time does not parse; time ahead of now by more
    than the margin; reading not finite; reading negative; a field missing; a
    field of the wrong type; a publish time beyond all years; a meter type outside the domain. Unknown fields are
    ignored, and time has no lower bound.
    """
    domain = METER_TYPES if domain is None else domain
    limit = (F.current_timestamp() if now is None else now.cast("timestamp")).cast("double") + margin_s
    when, number, raw = F.col("_when"), F.col("_number"), F.col("_text_meter_reading")
    kind = {f: F.col(f"_type_{f}") for f in FIELDS}
    numeric = kind["meter_reading"].rlike(NUMERIC)
    say = lambda before, value, after="": F.concat(F.lit(before), value.cast("string"), F.lit(after))
    return F.coalesce(
        F.when(~F.col("_object"), F.lit("not a JSON object")),
        F.when((kind["timestamp"] == "STRING") & when.isNull(), say("timestamp not ISO-8601: '", F.col("_text_timestamp"), "'")),
        F.when(when.cast("double") > limit, say("timestamp in the future (", when, ")")),
        F.when((kind["meter_reading"] == "STRING") & raw.startswith("#"), say("meter_reading not finite (", F.substring(raw, 2, 20), ")")),
        F.when(numeric & (F.isnan(number) | (F.abs(number) == float("inf"))), say("meter_reading not finite (", number, ")")),
        F.when(numeric & (number < 0), say("meter_reading negative (", number, ")")),
        *[F.when(kind[f].isNull(), F.lit(f"missing field '{f}'")) for f in FIELDS],
        F.when(kind["building_id"] != "STRING", F.lit("wrong type of 'building_id'")),
        F.when(when.isNull(), F.lit("wrong type of 'timestamp'")),
        F.when(~numeric, F.lit("wrong type of 'meter_reading'")),
        F.when(~kind["sim_publish_ts"].isin(*INTEGRAL), F.lit("wrong type of 'sim_publish_ts'")),
        F.when(_instant(F.col("_published")).isNull(), say("sim_publish_ts out of range (", F.col("_published"), ")")),
        F.when((kind["meter_type"] != "STRING") | ~F.col("_text_meter_type").isin(*domain), say("meter_type outside its domain: '", F.col("_text_meter_type"), "'")),
    )


def with_reason(df: DataFrame, payload: str = "payload", **rules) -> DataFrame:
    """Adds ``error``: why the payload is rejected, null if it is valid."""
    return with_fields(df, payload).select(*df.columns, _reason(**rules).alias("error"))


def validated(df: DataFrame, payload: str = "payload", **rules) -> DataFrame:
    """Adds ``error`` and the event's columns, from one parse of each payload."""
    return with_fields(df, payload).select(*df.columns, _reason(**rules).alias("error"), *_fields())


def route_valid(df: DataFrame, **options) -> DataFrame:
    """The events of the valid payloads."""
    return validated(df, **options).where("error is null").drop("error")


def route_rejected(df: DataFrame, **options) -> DataFrame:
    return with_reason(df, **options).where("error is not null")


def reason_class(error: Column) -> Column:
    """The reason without its values: what stands in round brackets or quotes becomes dots."""
    return F.regexp_replace(error, r"\([^)]*\)|'[^']*'|\"[^\"]*\"", "...")


def dead_letters(rejected: DataFrame, topic: Column, at_ms: Column) -> DataFrame:
    """One JSON record for each rejected payload, which is kept as it came."""
    record = F.struct(F.col("error"), topic.alias("source_topic"), at_ms.cast("long").alias("rejected_at_ms"), F.col("payload").alias("original_payload"))
    return rejected.select("event_id", F.to_json(record).alias("value"))


def reason_breakdown(rejected: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` commonest classes of reasons, and all others together as '(others)'."""
    counted = rejected.groupBy(reason_class(F.col("error")).alias("reason")).agg(F.count("*").alias("rejected"))
    top = counted.orderBy(F.col("rejected").desc(), "reason").limit(k)
    rest = counted.join(top.select("reason"), "reason", "left_anti").agg(F.sum("rejected").alias("rejected")).where("rejected is not null")
    return top.unionByName(rest.select(F.lit("(others)").alias("reason"), "rejected"))


def sensor_key(df: DataFrame) -> DataFrame:
    """The log key of a sensor and the topic its events come in on."""
    return df.withColumns({"sensor": F.concat_ws(":", "building_id", "meter_type"), "topic": F.concat_ws("/", F.lit("iot"), "building_id", "meter_type", F.lit("telemetry"))})


def build_payload(events: DataFrame) -> Column:
    """The event as the JSON that a meter sends: ISO time without zone, publish time in milliseconds."""
    return F.to_json(F.struct("building_id", "meter_type", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "meter_reading", F.unix_millis("sim_publish_ts").alias("sim_publish_ts")))


def nearest_rank(value: Column, order: Column, p: float, n: Column) -> Column:
    """Of ascending values numbered from 0 in ``order``: the one at floor(n * p)."""
    return F.max(F.when(order == F.floor(n * F.lit(p)), value))


def ingest_stats(received: DataFrame, latest: int = 10_000) -> DataFrame:
    """Totals of an ingest log (columns seq, status, latency_ms) and nearest-rank latencies of its latest published rows.

    Status is published, rejected or failed; what is in none of these is lost.
    """
    from pyspark.sql import Window

    totals = received.agg(
        F.count("*").alias("received"), F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "failed").alias("failures"),
    )
    totals = totals.withColumn("lost", F.greatest(F.lit(0), F.col("received") - F.col("published") - F.col("rejected")).cast("long")).withColumn("loss_pct", F.when(F.col("received") > 0, F.col("lost") / F.col("received") * 100.0).otherwise(0.0))
    recent = received.where((F.col("status") == "published") & F.col("latency_ms").isNotNull()).orderBy(F.col("seq").desc()).limit(latest)
    ranked = recent.withColumn("at", F.row_number().over(Window.orderBy("latency_ms")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    latency = ranked.agg(*[nearest_rank(F.col("latency_ms"), F.col("at"), p, F.col("n")).alias(f"latency_p{round(100 * p)}_ms") for p in (0.5, 0.95)], F.max("latency_ms").alias("latency_max_ms"))
    return totals.crossJoin(latency)


def log_depth(log: DataFrame) -> DataFrame:
    """Records in a log: over its partitions, last offset less first plus one."""
    per = log.groupBy("partition").agg((F.max("offset") - F.min("offset") + 1).alias("depth"))
    return per.agg(F.count("*").alias("partitions"), F.sum("depth").alias("depth"))
