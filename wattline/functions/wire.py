"""The wire format: a magic byte, a four-byte schema id and a schemaless Avro record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from wattline.functions import avro
from wattline.functions.cluster import ship

HEADER_BYTES = 5


def encode_header(schema_id: Column, payload: Column) -> Column:
    """Magic byte 0, the id big-endian in four bytes, the payload."""
    return F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(schema_id.cast("long")), 8, "0")), payload)


def split_header(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds schema_id and payload; a short value or another magic byte is an error when either is used."""
    v = F.col(value)
    well_formed = (F.length(v) >= HEADER_BYTES) & (F.hex(F.substring(v, 1, 1)) == "00")
    broken = F.raise_error(F.concat(F.lit("not a framed record: 0x"), F.hex(F.substring(v, 1, HEADER_BYTES))))
    return df.withColumns({
        "schema_id": F.when(well_formed, F.conv(F.hex(F.substring(v, 2, 4)), 16, 10).cast("long")).otherwise(broken.cast("long")),
        "payload": F.when(well_formed, F.substring(v, HEADER_BYTES + 1, 2**31 - 1)).otherwise(broken.cast("binary")),
    })


def guard_schema(df: DataFrame, expected: int, live: str = "meter_reading") -> DataFrame:
    """Fails on any record written with another schema.

    The check is part of the ``live`` column, so column pruning cannot drop it
    as long as a reading is used at all.
    """
    message = F.concat(F.lit("record written with schema "), F.coalesce(F.col("schema_id").cast("string"), F.lit("null")), F.lit(f", this query reads schema {expected}"))
    return df.withColumn(live, F.when(F.col("schema_id") == expected, F.col(live)).otherwise(F.raise_error(message).cast(df.schema[live].dataType)))


def spark_type(schema: dict) -> T.StructType:
    """The record's fields as Spark's types."""
    return T.StructType([T.StructField(f["name"], from_arrow_type(avro.arrow_type(f["type"]))) for f in schema["fields"]])


def decode_events(log: DataFrame, schema: dict, schema_id: int, writers: dict[int, dict] | None = None) -> DataFrame:
    """Log rows to flat events: header split, schema guard, records decoded a column at a time; any bad record fails.

    Records must be written with ``schema_id``, or with one of ``writers``, schemas
    by id, where these are given: a record is then read with its writer's schema
    and resolved to ``schema``. Runs alike on batches and streams. Log columns key,
    partition and offset are kept.
    """
    ship(log.sparkSession)
    framed = split_header(log)
    keep = [c for c in ("key", "partition", "offset") if c in log.columns]
    target = spark_type(schema)
    known = {schema_id: schema} | {int(k): v for k, v in (writers or {}).items()}

    def fields_of(number: int, payload: pa.Array) -> dict[str, pa.Array]:
        if number not in known:
            raise ValueError(f"record written with schema {number}, which is not registered")
        found = avro.decode(known[number], payload)
        return found if known[number] == schema else avro.resolve(known[number], schema, found, len(payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, ids = batch.column("payload"), batch.column("schema_id")
            told = pc.unique(ids).to_pylist()
            if len(told) <= 1:
                fields = fields_of(told[0] if told else schema_id, payload)
            else:  # records of each schema together, then back in their places
                places = [np.flatnonzero(np.asarray(pc.equal(ids, n))) for n in told]
                parts = [fields_of(n, payload.take(pa.array(at))) for n, at in zip(told, places)]
                back = pa.array(np.argsort(np.concatenate(places)))
                fields = {f: pa.concat_arrays([p[f] for p in parts]).take(back) for f in parts[0]}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *fields.values()], names=[*keep, *fields])

    # The guard stands before decoding: bytes of another schema must not be read with this one.
    guarded = framed if writers else guard_schema(framed, schema_id, "payload")
    return guarded.select(*keep, "schema_id", "payload").mapInArrow(run, T.StructType([*[log.schema[c] for c in keep], *target.fields]))


def encode_events(events: DataFrame, schema: dict, schema_id: int) -> DataFrame:
    """Events to log values: adds ``value``, the framed record."""
    ship(events.sparkSession)
    names = [f["name"] for f in schema["fields"] if f["name"] in events.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = avro.encode(schema, {x: batch.column(x) for x in names}, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, payload], names=[*batch.schema.names, "payload"])

    encoded = events.mapInArrow(run, T.StructType([*events.schema.fields, T.StructField("payload", T.BinaryType())]))
    return encoded.withColumn("value", encode_header(F.lit(schema_id), F.col("payload"))).drop("payload")
