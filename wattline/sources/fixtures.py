"""The domain's tables, derived from the generic star schema and event table that the driver supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.time import plus_millis, to_engine
from wattline.operators.dedup import stable_partition
from wattline.operators.enrich import enrich
from wattline.operators.metrics import windowed_metrics
from wattline.operators.prepare import sensor_baseline

DOMAIN = ["click", "error", "purchase", "signup", "view"]
AS_OF = "2024-02-01 00:00:00"


class Tables:
    """Tables of one data set folder, each read with the columns it needs only."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return to_engine(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def telemetry(self) -> DataFrame:
        """Events: sensor, time, whole readings, publish and ingest time."""
        reading = F.floor("value").cast("double")
        return self.read("events").select(
            F.col("user_id").cast("string").alias("building_id"), F.col("event_type").alias("meter_type"), F.col("ts").alias("timestamp"), reading.alias("meter_reading"),
            F.col("ts").alias("sim_publish_ts"), plus_millis(F.col("ts"), F.col("event_id") % 2000).alias("ingested_at"), "event_id",
        )

    def buildings(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        joined = self.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey")
        return joined.select(
            key.cast("string").alias("building_id"), F.col("s_nationkey").alias("site_id"), F.col("r_name").alias("primary_use"), F.floor("s_acctbal").cast("double").alias("square_feet"),
            F.when(key % 3 != 0, (key % 100 + 1900).cast("int")).alias("year_built"), F.when(key % 5 == 0, (key % 7 + 1).cast("int")).alias("floor_count"),
        )

    def baseline(self) -> DataFrame:
        return sensor_baseline(self.telemetry())

    def enriched(self) -> DataFrame:
        return enrich(self.telemetry(), self.buildings(), self.baseline())

    def metrics(self) -> DataFrame:
        """Hourly metrics with an ingest time, as the dashboard reads them."""
        found = windowed_metrics(self.enriched(), now=F.lit(AS_OF))
        return found.withColumn("ingested_at", plus_millis(F.col("max_sim_publish_ts"), F.col("event_count") * 250))

    def train(self) -> DataFrame:
        """Raw readings with coded meters."""
        codes = F.create_map(*[F.lit(x) for i, name in enumerate(DOMAIN) for x in (name, i)])
        return self.read("events").select(F.col("user_id").cast("int").alias("building_id"), codes[F.col("event_type")].alias("meter"), F.col("ts").alias("timestamp"), F.floor("value").cast("double").alias("meter_reading"))

    def metadata(self) -> DataFrame:
        return self.buildings().withColumn("building_id", F.col("building_id").cast("int"))

    def payloads(self) -> DataFrame:
        """One JSON payload an event; event_id modulo 25 below 8 has a fault, 8 an unknown field."""
        t = self.telemetry()
        fault = F.col("event_id") % 25
        quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
        body = F.concat(
            F.lit('{"building_id": '), F.when(fault == 4, F.col("building_id")).otherwise(quoted(F.col("building_id"))),
            F.lit(', "meter_type": '), quoted(F.when(fault == 2, "gas").otherwise(F.col("meter_type"))),
            F.lit(', "timestamp": '), quoted(F.when(fault == 3, "yesterday").when(fault == 5, "2099-01-01T00:00:00").otherwise(stamp)),
            F.when(fault == 1, "").otherwise(F.concat(F.lit(', "meter_reading": '), F.when(fault == 6, (-1 - F.col("meter_reading")).cast("string")).when(fault == 7, "NaN").otherwise(F.col("meter_reading").cast("string")))),
            F.lit(', "sim_publish_ts": '), F.unix_millis("sim_publish_ts").cast("string"), F.when(fault == 8, ', "note": {"a": [1, 2]}').otherwise(""), F.lit("}"),
        )
        return t.select("event_id", F.when(fault == 0, '{"building_id":').otherwise(body).alias("payload"))

    def received(self) -> DataFrame:
        fault = F.col("event_id") % 25
        status = F.when(fault < 8, "rejected").when(fault == 9, "failed").when(fault == 10, "pending").otherwise("published")
        return self.telemetry().select(F.col("event_id").alias("seq"), status.alias("status"), F.when(status == "published", F.col("meter_reading")).alias("latency_ms"))

    def deliveries(self) -> DataFrame:
        """The log's rows with redeliveries: every tenth event comes twice, every fiftieth with another reading."""
        first = self.telemetry().withColumn("seq", F.col("event_id"))
        second = first.where("event_id % 10 = 0").withColumns({"seq": F.col("event_id") + 1_000_000_000, "sim_publish_ts": plus_millis(F.col("sim_publish_ts"), F.lit(1500)), "meter_reading": F.col("meter_reading") + F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(0.0)})
        return first.unionByName(second).drop("event_id", "ingested_at")

    def log(self, partitions: int = 3) -> DataFrame:
        """Events as a keyed log: stable partition of the sensor key, offsets in event order."""
        from pyspark.sql import Window

        keyed = self.telemetry().withColumn("key", F.concat_ws(":", "building_id", "meter_type")).withColumn("partition", stable_partition(F.col("key"), partitions))
        return keyed.withColumn("offset", (F.row_number().over(Window.partitionBy("partition").orderBy("event_id")) - 1).cast("long"))

    def progress(self) -> DataFrame:
        """Micro-batch reports: an hour of a type is a batch."""
        hour = F.date_trunc("hour", F.col("ts"))
        grouped = self.read("events").groupBy(F.col("event_type").alias("query_name"), hour.alias("trigger_ts")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
        rows = F.when(F.hour("trigger_ts") % 5 == 0, 0).otherwise(F.col("n")).cast("long")
        timed = grouped.withColumns({"num_input_rows": rows, "duration_ms": (F.col("total") % 1000 + 1).cast("long"), "run_id": F.when(F.col("trigger_ts") < F.lit("2024-01-16").cast("timestamp"), "run1").otherwise("run2"), "batch_id": (F.unix_seconds("trigger_ts") / 3600).cast("long")})
        return timed.withColumn("processed_rows_per_second", F.col("num_input_rows") * 1000.0 / F.col("duration_ms")).select("trigger_ts", "run_id", "query_name", "batch_id", "num_input_rows", "processed_rows_per_second", "duration_ms")

    def rungs(self) -> DataFrame:
        """Load-ladder results: a day of events is a rung."""
        day = F.dayofmonth("ts")
        grouped = self.read("events").groupBy(day.alias("d")).agg(F.count("*").alias("n"), F.max(F.floor("value")).cast("double").alias("latency_p95_s"))
        return grouped.select(
            F.concat(F.lit("day "), F.lpad(F.col("d").cast("string"), 2, "0")).alias("label"), (F.col("d") * 10).alias("sensors"), F.col("n").cast("double").alias("requested_rate"),
            (F.col("n") * F.when(F.col("d") % 7 == 0, 0.9).otherwise(1.0).cast("double")).alias("published_rate"), "latency_p95_s", (F.col("d") == 30).alias("hot_base"),
        )
