"""Shared parts: keys of rows, sums of blocks, filters, hashes of spans, parts of long texts."""

import numpy as np
import pyarrow as pa

from wattline.llm.filters import bloom, may_hold
from wattline.llm.runtime import block, spare, sum_blocks, with_key
from wattline.llm.textkit import mix, parts, span_hash


def test_keys(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, None), (5, "x"), (5, "y"), (5, "y"), (5, None)]
    found = [tuple(r) for r in with_key(spark.createDataFrame(rows, "doc_id long, text string"), "_key").collect()]
    assert len(found) == len(rows)
    keys = {(d, t): k for d, t, k in found}
    assert len(set(keys.values())) == len(keys) and keys[1, "a"] == 1 and keys[2, "b"] == 2 and 5 in keys.values()
    assert spare(["_key", "_KEY_"], "_key", "_tie") == ["_key__", "_tie"]


def test_sums_of_blocks(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, (300, 50))
    rows = [(int(i % 3), bytearray(block(x))) for i, x in enumerate(values)]
    out = dict(sum_blocks(spark.createDataFrame(rows, "chunk int, counts binary").repartition(9), fan=4))
    assert all((out[c] == values[c::3].sum(axis=0)).all() for c in range(3))
    assert sum_blocks(spark.createDataFrame([], "chunk int, counts binary")) == []


def test_filters_hold_what_they_were_given(spark):
    held = mix(np.arange(5000, dtype=np.uint64))
    flags = bloom(spark.createDataFrame([(int(x),) for x in held.view(np.int64)], "h long"), len(held))
    other = mix(np.arange(10**6, 10**6 + 50_000, dtype=np.uint64))
    assert may_hold(flags, held).all() and may_hold(flags, other).mean() < 0.1


def test_span_hashes_do_not_depend_on_where_spans_stand():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 400_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 150_000, 3000))
    ends = starts + rng.integers(1, 40, 3000)
    starts, ends = np.append(starts, [150_000, 250_000]), np.append(ends, [250_000, 400_000])
    data[250_000:350_000] = data[150_000:250_000]
    h = span_hash(data, starts, ends)
    for i in (0, 77, 2999, 3000, 3001):
        assert h[i] == span_hash(data[starts[i] : ends[i]].copy(), np.array([0]), np.array([ends[i] - starts[i]]))[0]
    assert h[3000] != h[3001] and h[3000] == span_hash(data, np.array([250_000]), np.array([350_000]))[0]


def test_long_texts_in_parts():
    texts = pa.array(["short", None, "é" * 5000, "word " * 3000, ""])
    seen: dict[int, str] = {}
    for a, b, part in parts(texts, b" ", most_bytes=1000):
        for i, x in zip(range(a, b), part.to_pylist()):
            seen[i] = seen.get(i, "") + (x or "")
    assert [seen.get(i, "") for i in range(5)] == [x or "" for x in texts.to_pylist()]
