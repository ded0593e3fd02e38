"""Contract validation, wire format, governance."""

import json
import random
import struct
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattline.functions import avro, wire
from wattline.operators.contract import parsed, reason_breakdown, reason_class, with_reason
from wattline.operators.governance import SchemaRejected, check_evolution, enum_order_changes
from wattline.schemas import METER_TYPES, avro_schema
from wattline.sources.readers import SchemaCatalog

NOW = "2025-01-01 00:00:00"
GOOD = {"building_id": "156", "meter_type": "steam", "timestamp": "2016-01-01T00:00:00", "meter_reading": 1.5, "sim_publish_ts": 1700000000000}


def case(**changes):
    record = {k: v for k, v in {**GOOD, **changes}.items() if v is not ...}
    return json.dumps(record)


CASES = [
    (case(), None), (case(extra={"a": 1}), None), (case(meter_reading=1e100), None), (case(meter_reading=0), None), (case(timestamp="2025-01-01T00:05:00"), None), (case(timestamp="2016-01-01T01:00:00+01:00"), None),
    ('{"building_id":', "not a JSON object"), ("[1]", "not a JSON object"), ("7", "not a JSON object"), (None, "not a JSON object"), ("", "not a JSON object"),
    (case(meter_reading=...), "missing field"), (case(building_id=...), "missing field"), (case(timestamp=...), "missing field"),
    (case(meter_type="gas"), "domain"), (case(meter_type=3), "domain"), (case(timestamp="yesterday"), "ISO-8601"), (case(timestamp="2025-01-01T00:05:01"), "future"),
    (case(building_id=156), "building_id"), (case(building_id=156.9), "building_id"), (case(building_id=True), "building_id"), (case(building_id=2**40), "building_id"),
    (case(meter_reading=-1), "negative"), (case(meter_reading=float("nan")), "not finite"), (case(meter_reading=float("inf")), "not finite"), (case(meter_reading=float("-inf")), "not finite"),
    (case(meter_reading="7"), "meter_reading"), (case(meter_reading=True), "meter_reading"), (case(meter_reading=None), "meter_reading"), (case(sim_publish_ts="x"), "sim_publish_ts"), (case(sim_publish_ts=10**18 - 1), "out of range"), (case(timestamp=10**18 - 1), "timestamp"), (case(timestamp=True), "timestamp"),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CASES)], "event_id int, payload string")
    got = {r["event_id"]: r["error"] for r in with_reason(df, now=F.lit(NOW)).collect()}
    for i, (payload, want) in enumerate(CASES):
        assert (got[i] is None) if want is None else (got[i] is not None and want in got[i]), (payload, got[i])
    row = parsed(df.where("event_id = 0")).first()
    assert (row["building_id"], row["meter_reading"], row["timestamp"]) == ("156", 1.5, datetime(2016, 1, 1))


def test_breakdown_and_class(spark):
    df = spark.createDataFrame([("a (1)",), ("a (2)",), ("b 'x' \"y\"",)], "error string")
    assert {r[0] for r in df.select(reason_class(F.col("error"))).collect()} == {"a ...", "b ... ..."}
    assert [(r["reason"], r["rejected"]) for r in reason_breakdown(df, 1).collect()] == [("a ...", 2), ("(others)", 1)]


def test_header_and_guard(spark):
    df = spark.createDataFrame([(300, b"abc", 1.0)], "id int, body binary, meter_reading double")
    framed = wire.split_header(df.select(wire.encode_header(F.col("id"), F.col("body")).alias("value"), "meter_reading"))
    assert framed.select("schema_id", "payload").first() == (300, bytearray(b"abc"))
    assert wire.guard_schema(framed, 300).agg(F.sum("meter_reading")).first()[0] == 1.0
    with pytest.raises(Exception, match="schema 300, this query reads schema 7"):
        wire.guard_schema(framed, 7).agg(F.sum("meter_reading")).collect()
    for bad in (b"\x01\x00\x00\x01\x2cabc", b"\x00\x00"):
        with pytest.raises(Exception, match="not a framed record"):
            wire.split_header(spark.createDataFrame([(bad,)], "value binary")).select("payload").collect()


def test_events_survive_the_log(spark):
    moment = datetime(2016, 1, 2, 3, 4, 5, 6000)
    events = spark.createDataFrame([("é1", "steam", moment, 1.25, moment)], "building_id string, meter_type string, timestamp timestamp, meter_reading double, sim_publish_ts timestamp")
    coded = wire.encode_events(events, avro_schema(), 9).select("value")
    assert wire.decode_events(coded, avro_schema(), 9).first() == events.first()
    with pytest.raises(Exception, match="reads schema 8"):
        wire.decode_events(coded, avro_schema(), 8).collect()


@given(st.text(max_size=20), st.sampled_from(METER_TYPES), st.integers(-(2**62), 2**62), st.floats(allow_nan=False), st.one_of(st.none(), st.text(max_size=5)))
def test_record_round_trip(building, meter, millis, reading, quality):
    schema = avro_schema(2)
    for field in schema["fields"]:
        if field["name"] in ("timestamp", "sim_publish_ts"):
            field["type"] = "long"
    record = {"building_id": building, "meter_type": meter, "timestamp": millis, "meter_reading": reading, "sim_publish_ts": 0, "reading_quality": quality}
    assert avro.decode_record(schema, avro.encode_record(schema, record)) == record


def test_what_does_not_fit_is_refused():
    good = {"building_id": "1", "meter_type": "steam", "timestamp": datetime(2020, 1, 1, tzinfo=timezone.utc), "meter_reading": 1.0, "sim_publish_ts": 5}
    avro.encode_record(avro_schema(), good)
    for change in ({"building_id": 1}, {"meter_type": "gas"}, {"meter_reading": True}, {"timestamp": "x"}):
        with pytest.raises(ValueError):
            avro.encode_record(avro_schema(), good | change)
    with pytest.raises(ValueError, match="missing"):
        avro.encode_record(avro_schema(), {k: v for k, v in good.items() if k != "building_id"})


def plain_long(n):
    """A zigzag variable-length integer, byte by byte."""
    z, out = ((n << 1) ^ (n >> 63)) & (2**64 - 1), b""
    while z > 127:
        out, z = out + bytes([z & 127 | 128]), z >> 7
    return out + bytes([z])


@given(st.lists(st.tuples(st.text(max_size=6), st.sampled_from(METER_TYPES), st.integers(-(2**61), 2**61), st.floats(allow_nan=False), st.one_of(st.none(), st.text(max_size=3))), max_size=12))
def test_batches_are_the_bytes_of_the_format(rows):
    """Whole batches, empty ones too, against bytes put together by hand, and back."""
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "string"}, {"name": "b", "type": {"type": "enum", "name": "e", "symbols": METER_TYPES}}, {"name": "c", "type": "long"}, {"name": "d", "type": "double"}, {"name": "e", "type": ["null", "string"], "default": None}]}
    kinds = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
    columns = {f["name"]: pa.array([r[i] for r in rows], kinds[i]) for i, f in enumerate(schema["fields"])}
    text = lambda x: plain_long(len(x.encode())) + x.encode()
    want = [text(a) + plain_long(METER_TYPES.index(b)) + plain_long(c) + struct.pack("<d", d) + (b"\x00" if e is None else b"\x02" + text(e)) for a, b, c, d, e in rows]
    coded = avro.encode(schema, columns, len(rows))
    assert coded.to_pylist() == want
    assert {k: v.to_pylist() for k, v in avro.decode(schema, coded).items()} == {k: v.to_pylist() for k, v in columns.items()}
    for i, raw in enumerate(want):
        for bad in (raw[:-1], raw + b"x"):
            with pytest.raises((ValueError, pa.ArrowInvalid)):
                avro.decode(schema, pa.array([*want[:i], bad, *want[i + 1 :]], pa.binary()))


def with_symbols(symbols):
    schema = avro_schema()
    schema["fields"][1]["type"]["symbols"] = symbols
    return schema


def test_evolution(tmp_path):
    check_evolution(avro_schema(1), avro_schema(2))
    check_evolution(avro_schema(), with_symbols([*METER_TYPES, "gas"]))
    for bad in (METER_TYPES[::-1], [*METER_TYPES[:2], "gas", *METER_TYPES[2:]], METER_TYPES[:-1]):
        with pytest.raises(SchemaRejected, match="index"):
            check_evolution(avro_schema(), with_symbols(bad))
    no_default = avro_schema(2)
    del no_default["fields"][-1]["default"]
    with pytest.raises(SchemaRejected, match="no default"):
        check_evolution(avro_schema(1), no_default)
    other = avro_schema()
    other["fields"][0]["type"] = "long"
    with pytest.raises(SchemaRejected, match="type"):
        check_evolution(avro_schema(), other)
    catalog = SchemaCatalog(str(tmp_path / "schemas.json"))
    assert catalog.register("event", avro_schema(1)) == (1, True) and catalog.register("event", avro_schema(1)) == (1, False)
    assert catalog.register("event", avro_schema(2)) == (2, True)
    again = SchemaCatalog(str(tmp_path / "schemas.json"))
    assert again.latest("event") == (2, avro_schema(2)) and again.by_id(1) == avro_schema(1)
    with pytest.raises(KeyError):
        again.by_id(5)
    with pytest.raises(SchemaRejected):
        again.register("event", with_symbols(METER_TYPES[::-1]))


@given(st.lists(st.sampled_from("abcdef"), unique=True, min_size=1), st.lists(st.sampled_from("abcdef"), unique=True, min_size=1))
def test_only_appending_keeps_an_enum(old, new):
    assert (enum_order_changes(with_symbols(old), with_symbols(new)) == []) == (new[: len(old)] == old)


def test_the_common_shape_reads_like_any_json(spark, monkeypatch):
    """Rows that take the short way get the reasons and fields that the long way gives."""
    from wattline.operators import contract

    rng = random.Random(1)
    readings = ["1.5", "0", "0.5", "0.0", "-3", "1e3", "1E-7", "12345678901234", "0.1", "99999999999999.25", "01", "1.", ".5", "1e400", "-1e400", "NaN", '"7"', "true", "null", "123456789012345678901234567890"]
    stamps = ['"2016-01-01T00:00:00"', '"2016-01-01T00:00:00.123+01:00"', '"2016-01-01"', '"yesterday"', '""', '"2099-01-01T00:00:00"', "1700000000000", '"2016-13-01T00:00:00"', '"2016-01-01T25:00:00"']
    names = ['"156"', '""', '"a b"', '"é日"', '"a\\\\"b"', '"tab\\\\t"', "7", "null"]
    types = ['"steam"', '"gas"', '"unknown"', '""', "3"]
    published = ["1700000000000", "0", "-5", "999999999999999999", "9999999999999999999", "1.5", '"x"']
    gaps = lambda: (rng.choice(["", " ", " ", "  "]), rng.choice(["", " ", " ", "\t"]))
    rows = []
    for i in range(3000):
        a, b = gaps()
        fields = [("building_id", rng.choice(names)), ("meter_type", rng.choice(types)), ("timestamp", rng.choice(stamps)), ("meter_reading", rng.choice(readings[:10] if rng.random() < 0.5 else readings)), ("sim_publish_ts", rng.choice(published))]
        if rng.random() < 0.1:
            rng.shuffle(fields)
        if rng.random() < 0.05:
            fields.append(rng.choice(fields))
        body = ("," + a).join(f'"{k}":{b}{v}' for k, v in fields)
        rows.append((i, "{" + body + "}" + rng.choice(["", "", "", "", " ", "\n", "x"])))
    df = spark.createDataFrame(rows, "event_id int, payload string")
    flat = df.where(F.col("payload").rlike(contract.FLAT)).count()
    assert 100 < flat < 2900
    both = []
    for pattern in (contract.FLAT, "(?!)"):
        monkeypatch.setattr(contract, "FLAT", pattern)
        both.append({r["event_id"]: tuple(map(str, r)) for r in contract.validated(df, now=F.lit(NOW)).collect()})
    assert both[0] == both[1]


def test_schemas_are_resolved():
    old, new = avro_schema(1), avro_schema(2)
    new["fields"][1]["type"] = {"type": "enum", "name": "MeterType", "symbols": [*METER_TYPES, "water"], "default": "unknown"}
    record = {"building_id": "1", "meter_type": "steam", "timestamp": datetime(2024, 1, 1, tzinfo=timezone.utc), "meter_reading": 2.5, "sim_publish_ts": datetime(2024, 1, 1, tzinfo=timezone.utc)}
    read = lambda writer, reader, data: {k: v[0].as_py() for k, v in avro.resolve(writer, reader, avro.decode(writer, pa.array([data], pa.binary())), 1).items()}
    assert read(old, new, avro.encode_record(old, record)) == record | {"reading_quality": None}
    later = record | {"meter_type": "water", "reading_quality": "good"}
    assert read(new, old, avro.encode_record(new, later)) == record | {"meter_type": "unknown"}  # what its reader doesn't know takes its default
    strict = json.loads(json.dumps(old))
    del strict["fields"][1]["type"]["default"]
    with pytest.raises(ValueError, match="'water' is not a symbol"):
        read(new, strict, avro.encode_record(new, later))
    one = lambda kind, **more: {"type": "record", "name": "R", "fields": [{"name": "x", "type": kind, **more}]}
    assert read(one("long"), one("double"), avro.encode_record(one("long"), {"x": 3})) == {"x": 3.0}
    assert read(one("long"), one(["null", "long"]), avro.encode_record(one("long"), {"x": 3})) == {"x": 3}
    assert read(one(["null", "long"]), one("double"), avro.encode_record(one(["null", "long"]), {"x": 3})) == {"x": 3.0}
    with pytest.raises(ValueError, match="is null"):
        read(one(["null", "long"]), one("long"), avro.encode_record(one(["null", "long"]), {"x": None}))
    with pytest.raises(ValueError, match="cannot be read as"):
        read(one("string"), one("long"), avro.encode_record(one("string"), {"x": "3"}))
    with pytest.raises(ValueError, match="has no default"):
        avro.resolve(one("long"), {"type": "record", "name": "R", "fields": [{"name": "y", "type": "long"}]}, {"x": pa.array([1])}, 1)


def test_a_log_of_two_schemas(spark):
    old, new = avro_schema(1), avro_schema(2)
    rows = [(str(n), "steam", datetime(2024, 1, 1), float(n), datetime(2024, 1, 1)) for n in range(30)]
    events = spark.createDataFrame(rows, "building_id string, meter_type string, timestamp timestamp, meter_reading double, sim_publish_ts timestamp")
    first = wire.encode_events(events.where("meter_reading < 20"), old, 1).select("value")
    second = wire.encode_events(events.where("meter_reading >= 20").withColumn("reading_quality", F.lit("good")), new, 2).select("value")
    log = first.unionByName(second).repartition(3, "value")
    read = wire.decode_events(log, new, 2, {1: old, 2: new}).collect()
    assert sorted((r["building_id"], r["meter_reading"], r["reading_quality"]) for r in read) == sorted((str(n), float(n), "good" if n >= 20 else None) for n in range(30))
    assert wire.decode_events(log, old, 1, {1: old, 2: new}).agg(F.sum("meter_reading")).first()[0] == sum(range(30))
    with pytest.raises(Exception, match="schema 2, which is not registered"):
        wire.decode_events(log, old, 1, {1: old}).collect()
    with pytest.raises(Exception, match="written with schema"):
        wire.decode_events(log, new, 2).collect()
