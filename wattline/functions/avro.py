"""Schemaless Avro records of flat fields, a column at a time: batches of records to Arrow columns and back."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LONGEST_VARINT = 10


def kind_of(spec) -> tuple[str, object]:
    """A field's kind (a logical type by its own name) and its full specification."""
    if isinstance(spec, list):
        return "union", spec
    if isinstance(spec, dict):
        return ("millis" if spec.get("logicalType") == "timestamp-millis" else spec["type"]), spec
    return spec, spec


ARROW = {"string": pa.string(), "enum": pa.string(), "long": pa.int64(), "double": pa.float64(), "millis": pa.timestamp("us", tz="UTC")}


def arrow_type(spec) -> pa.DataType:
    kind, full = kind_of(spec)
    if kind == "union":
        return arrow_type(next(x for x in full if x != "null"))
    if kind not in ARROW:
        raise ValueError(f"unsupported type {kind}")
    return ARROW[kind]


# --- reading -----------------------------------------------------------------
class _Reader:
    """The records of a batch end to end, and for each the place up to which it has been read."""

    def __init__(self, payload: pa.Array):
        payload = payload.cast(pa.large_binary())
        _, where, data = payload.buffers()
        offsets = np.frombuffer(where, np.int64)[payload.offset : payload.offset + len(payload) + 1]
        self.data = np.concatenate((np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8)))
        self.at, self.end = offsets[:-1].copy(), offsets[1:]

    def _room(self, rows: np.ndarray, size) -> None:
        if len(rows) and (self.at[rows] + size > self.end[rows]).any():
            raise ValueError("record ends within a field")

    def longs(self, rows: np.ndarray) -> np.ndarray:
        """Zigzag variable-length integers, a byte of all that are not yet complete in each step."""
        z, open_, shift = np.zeros(len(rows), U64), np.arange(len(rows)), 0
        while len(open_):
            if shift >= 7 * LONGEST_VARINT:
                raise ValueError("a number of more than ten bytes")
            self._room(rows[open_], 1)
            byte = self.data[self.at[rows[open_]]]
            z[open_] |= (byte & 0x7F).astype(U64) << U64(shift)
            self.at[rows[open_]] += 1
            open_, shift = open_[byte >= 0x80], shift + 7
        return (z >> U64(1)).view(np.int64) ^ -(z & U64(1)).view(np.int64)

    def read(self, spec, rows: np.ndarray) -> pa.Array:
        kind, full = kind_of(spec)
        if kind == "union":
            branch = self.longs(rows)
            if len(rows) and (branch.min() < 0 or branch.max() >= len(full)):
                raise ValueError("no such branch of a union")
            there = np.flatnonzero(branch != full.index("null"))
            if len(full) != 2:
                raise ValueError("unions of null and one type only")
            values = self.read(next(x for x in full if x != "null"), rows[there])
            places = np.full(len(rows), -1, np.int64)
            places[there] = np.arange(len(there))
            return values.take(pa.array(places, mask=places < 0))
        if kind == "string":
            size = self.longs(rows)
            if len(size) and size.min() < 0:
                raise ValueError("a string of negative length")
            self._room(rows, size)
            offsets = np.concatenate(([0], np.cumsum(size)))
            picked = self.data[np.repeat(self.at[rows] - offsets[:-1], size) + np.arange(offsets[-1])]
            self.at[rows] += size
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.tobytes())])
            return raw.cast(pa.large_string()).cast(pa.string())
        if kind == "enum":
            index = self.longs(rows)
            if len(index) and (index.min() < 0 or index.max() >= len(full["symbols"])):
                raise ValueError("no such symbol of an enum")
            return pa.array(full["symbols"], pa.string()).take(pa.array(index))
        if kind == "double":
            self._room(rows, 8)
            values = np.ndarray((len(self.data) - 7,), "<f8", self.data, strides=(1,))[self.at[rows]]
            self.at[rows] += 8
            return pa.array(values)
        if kind == "long":
            return pa.array(self.longs(rows))
        if kind == "millis":
            return pa.array(self.longs(rows)).cast(pa.timestamp("ms", tz="UTC")).cast(ARROW["millis"])
        raise ValueError(f"unsupported type {kind}")


def decode(schema: dict, payload: pa.Array) -> dict[str, pa.Array]:
    """The fields of all records; ValueError if any is too short, too long or holds what the schema does not allow."""
    if payload.null_count:
        raise ValueError("a record is null")
    reader, rows = _Reader(payload), np.arange(len(payload))
    found = {field["name"]: reader.read(field["type"], rows) for field in schema["fields"]}
    if (reader.at != reader.end).any():
        raise ValueError(f"{int((reader.end - reader.at).max())} bytes after the record")
    return found


def _as_read(writer, reader, values: pa.Array, name: str) -> pa.Array:
    """A field's values, written with one type, in the type that the reader asks for."""
    (kind, _), (wanted, full) = kind_of(writer), kind_of(reader)
    inner = next((x for x in full if x != "null"), None) if wanted == "union" else reader
    if wanted != "union" and values.null_count:
        raise ValueError(f"field {name} is null, its reader allows no null")
    if kind_of(inner)[0] == "enum":
        known = kind_of(inner)[1]
        strange = pc.and_(values.is_valid(), pc.invert(pc.is_in(values, pa.array(known["symbols"], pa.string()))))
        if not pc.any(strange, min_count=0).as_py():
            return values
        if "default" not in known:
            raise ValueError(f"field {name}: {values.filter(strange)[0].as_py()!r} is not a symbol of the reader's enum")
        return pc.if_else(strange, pa.scalar(known["default"]), values)
    written = next(x for x in writer if x != "null") if kind == "union" else writer
    if kind_of(written)[0] == kind_of(inner)[0]:
        return values
    if (kind_of(written)[0], kind_of(inner)[0]) == ("long", "double"):
        return values.cast(pa.float64())
    raise ValueError(f"field {name} was written as {kind_of(written)[0]} and cannot be read as {kind_of(inner)[0]}")


def resolve(writer: dict, reader: dict, found: dict[str, pa.Array], rows: int) -> dict[str, pa.Array]:
    """The reader's fields out of columns read with the writer's schema: its own fields by name, defaults for those that were not written."""
    written = {f["name"]: f["type"] for f in writer["fields"]}
    out = {}
    for field in reader["fields"]:
        name, kind = field["name"], arrow_type(field["type"])
        if name in written:
            out[name] = _as_read(written[name], field["type"], found[name], name)
        elif "default" in field:
            out[name] = pa.array([field["default"]] * rows, kind)
        else:
            raise ValueError(f"field {name} was not written and has no default")
    return out


# --- writing -----------------------------------------------------------------
class _Part:
    """One field's bytes of every record: how many, and how they are put at given places of the result."""

    def __init__(self, sizes: np.ndarray, put):
        self.sizes, self.put = sizes, put


def _long_part(values: np.ndarray) -> _Part:
    z = ((values << 1) ^ (values >> 63)).view(U64)
    sizes = np.ones(len(z), np.int64)
    for k in range(1, LONGEST_VARINT):
        sizes += (z >> U64(7 * k)) > 0

    def put(out: np.ndarray, at: np.ndarray) -> None:
        for k in range(int(sizes.max(initial=0))):
            more = np.flatnonzero(sizes > k)
            out[at[more] + k] = ((z[more] >> U64(7 * k)) & U64(0x7F)).astype(np.uint8) | np.where(sizes[more] - 1 > k, 0x80, 0).astype(np.uint8)

    return _Part(sizes, put)


def _both(first: _Part, second: _Part) -> _Part:
    def put(out: np.ndarray, at: np.ndarray) -> None:
        first.put(out, at)
        second.put(out, at + first.sizes)

    return _Part(first.sizes + second.sizes, put)


def _part(spec, values: pa.Array) -> _Part:
    kind, full = kind_of(spec)
    if kind == "union":
        null = full.index("null")
        there = np.flatnonzero(np.asarray(values.is_valid()))
        branch = np.full(len(values), null, np.int64)
        branch[there] = 1 - null
        inner = _part(next(x for x in full if x != "null"), values.drop_null())
        sizes = np.zeros(len(values), np.int64)
        sizes[there] = inner.sizes
        return _both(_long_part(branch), _Part(sizes, lambda out, at: inner.put(out, at[there])))
    if values.null_count:
        raise ValueError(f"null is not a {kind}")
    if kind == "string":
        raw = values.cast(pa.large_string()).cast(pa.large_binary())
        _, where, data = raw.buffers()
        offsets = np.frombuffer(where, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        begins = offsets[:-1] - offsets[0]

        def put(out: np.ndarray, at: np.ndarray) -> None:
            out[np.repeat(at - begins, sizes) + np.arange(len(body))] = body

        return _both(_long_part(sizes.astype(np.int64)), _Part(sizes, put))
    if kind == "enum":
        index = pc.index_in(values, pa.array(full["symbols"], pa.string()))
        if index.null_count:
            raise ValueError(f"{values.filter(index.is_null())[0].as_py()!r} is not a symbol of the enum")
        return _long_part(np.asarray(index, np.int64))
    if kind == "double":
        body = np.ascontiguousarray(np.asarray(values.cast(pa.float64())), "<f8").view(np.uint8).reshape(-1, 8)

        def put_eight(out: np.ndarray, at: np.ndarray) -> None:
            out[at[:, None] + np.arange(8)] = body

        return _Part(np.full(len(values), 8, np.int64), put_eight)
    if kind == "millis" and pa.types.is_timestamp(values.type):
        # Down to the millisecond below, before 1970 too.
        micros = np.asarray(values.cast(pa.timestamp("us", tz=values.type.tz)).cast(pa.int64()))
        return _long_part(micros // 1000)
    if kind in ("long", "millis"):
        return _long_part(np.asarray(values.cast(pa.int64())))
    raise ValueError(f"unsupported type {kind}")


def encode(schema: dict, columns: dict[str, pa.Array], rows: int) -> pa.Array:
    """The records of all rows as an array of binaries; a column that is missing takes its field's default."""
    found = []
    for field in schema["fields"]:
        name = field["name"]
        if name not in columns and "default" not in field:
            raise ValueError(f"missing field {name}")
        values = columns[name] if name in columns else pa.array([field["default"]] * rows, arrow_type(field["type"]))
        found.append(_part(field["type"], values))
    sizes = sum((p.sizes for p in found), np.zeros(rows, np.int64))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    out, at = np.zeros(offsets[-1], np.uint8), offsets[:-1].copy()
    for p in found:
        p.put(out, at)
        at += p.sizes
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
    return whole.cast(pa.binary())


# --- single records ----------------------------------------------------------
def encode_record(schema: dict, record: dict) -> bytes:
    """One record; ValueError names what does not fit."""
    columns = {}
    for field in schema["fields"]:
        if field["name"] not in record:
            continue
        value, kind = record[field["name"]], arrow_type(field["type"])
        if isinstance(value, bool):
            raise ValueError(f"{field['name']}: {value!r} is not a {kind}")
        if kind == ARROW["millis"] and isinstance(value, int):
            kind = pa.int64()
        elif isinstance(value, datetime) and value.tzinfo is None:
            value = value.replace(tzinfo=timezone.utc)
        try:
            columns[field["name"]] = pa.array([value], kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as error:
            raise ValueError(f"{field['name']}: {value!r} is not a {kind}") from error
    return encode(schema, columns, 1)[0].as_py()


def decode_record(schema: dict, data: bytes) -> dict:
    return {name: column[0].as_py() for name, column in decode(schema, pa.array([data], pa.binary())).items()}
