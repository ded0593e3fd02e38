"""From meters' JSON payloads to the log: validation, dead letters and totals."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import wire
from wattline.operators.contract import FIELDS, dead_letters, reason_breakdown, sensor_key, validated
from wattline.operators.dedup import stable_partition

log = logging.getLogger(__name__)
#: Writes rows of a batch, given its number and the number of rows.
Writer = Callable[[DataFrame, int, int], None]


def log_rows(events: DataFrame, schema: dict, schema_id: int, partitions: int) -> DataFrame:
    """key, partition, timestamp and framed value of events; a sensor's events share a partition. The log gives them offsets."""
    keyed = sensor_key(wire.encode_events(events.select(*FIELDS), schema, schema_id)).withColumn("partition", stable_partition(F.col("sensor"), partitions))
    return keyed.select(F.col("sensor").alias("key"), "partition", "timestamp", "value")


@dataclass
class IngestTotals:
    """What has come in since the start, by outcome; ``lost`` is what came in and went nowhere."""

    received: int = 0
    published: int = 0
    rejected: int = 0
    reasons: dict[str, int] = field(default_factory=dict)

    @property
    def lost(self) -> int:
        return max(0, self.received - self.published - self.rejected)

    def add(self, published: int, rejected: int, reasons: dict[str, int]) -> None:
        self.received += published + rejected
        self.published += published
        self.rejected += rejected
        for k, n in reasons.items():
            self.reasons[k] = self.reasons.get(k, 0) + n


def ingest_writer(to_log: Writer, to_dead_letters: Writer, schema: dict, schema_id: int, totals: IngestTotals | None = None, topic: str = "iot/#", partitions: int = 3, report_every: int = 0, **rules) -> Writer:
    """A ``foreachBatch`` function over payloads: valid ones go to the log, all others, as they came, to the dead letters.

    A payload is parsed once. The log is written first; a batch that fails
    between the two writes is replayed, and both writers take the same rows again
    without harm. Every ``report_every`` batches the totals are logged.
    """
    totals = IngestTotals() if totals is None else totals

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validated(batch.withColumn("event_id", F.monotonically_increasing_id()), **rules).persist()
        try:
            counts = {r["bad"]: r["n"] for r in checked.groupBy(F.col("error").isNotNull().alias("bad")).agg(F.count("*").alias("n")).collect()}
            good, bad = counts.get(False, 0), counts.get(True, 0)
            if good:
                to_log(log_rows(checked.where("error is null"), schema, schema_id, partitions), batch_id, good)
            reasons: dict[str, int] = {}
            if bad:
                rejected = checked.where("error is not null")
                letters = dead_letters(rejected, F.lit(topic), F.unix_millis(F.current_timestamp())).select(F.lit(None).cast("string").alias("key"), F.col("value").cast("binary").alias("value"))
                to_dead_letters(letters, batch_id, bad)
                reasons = {r["reason"]: r["rejected"] for r in reason_breakdown(rejected).collect()}
            totals.add(good, bad, reasons)
            if report_every and (batch_id + 1) % report_every == 0:
                log.info("received %d, published %d, rejected %d, lost %d", totals.received, totals.published, totals.rejected, totals.lost)
        finally:
            checked.unpersist()

    return write


class DropCounter:
    """Messages that a broker says it has dropped, counted from the moment this was made.

    ``read`` gives the broker's running total, or None where it tells nothing;
    a total that falls means that the broker was restarted, and counts from 0.
    """

    def __init__(self, read: Callable[[], int | None]):
        self.read = read
        self.last, self.dropped = read(), 0

    def delta(self) -> int | None:
        now = self.read()
        if now is None:
            return None
        before = self.last or 0
        self.dropped += now - before if now >= before else now
        self.last = now
        return self.dropped
