"""Sharding: the bytes law, gapless slots, and every row once."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattline.llm.sharding import shard_by_sampled_splitters


def check(spark, rows, shards):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, shard string, size int").repartition(3)
    out = shard_by_sampled_splitters(docs, shards=shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    total, most = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for shard in range(shards):
        mine = [r for r in out if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / shards) < 2 * most + 0.02 * total / shards
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None} and {r["shard"] for r in out} <= set(range(shards))
    return out


def test_bytes_law_with_hot_text(spark):
    rng = random.Random(6)
    rows = [(i, "hot text, a third of all rows" if i % 3 == 0 else "é" * rng.choice([0, 1, 30, 200])) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "z" * 4000), (None, "null id"), (7, "again"), (7, "again")]
    check(spark, rows, 40)


def test_small_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 4}") for i in range(4000)]
    out = check(spark, rows, 5)
    assert not [t for t in range(1000) if len({r["shard"] for r in out if r["doc_id"] // 4 == t}) > 1]


@pytest.mark.parametrize("hot", [0, 3])
def test_against_running_totals(spark, hot):
    """Shards and slots against one sorted list of all rows with its running totals."""
    rng = random.Random(hot)
    rows = [(i, "the same" if hot and i % hot == 0 else f"t{rng.randrange(400)} " * rng.choice([1, 3, 40])) for i in range(2500)] + [(None, None), (9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("a"), F.xxhash64("doc_id").alias("b")).collect()
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(((r["a"], r["b"], size(r["text"]), r["doc_id"]) for r in keyed), key=lambda x: x[:3])
    total, shards = sum(x[2] for x in order), 7
    group = Counter()
    for a, _, n, _ in order:
        group[a] += n
    want, ahead, begins = [], 0, {}
    for a, _, n, i in order:
        begins.setdefault(a, ahead)
        at = begins[a] if group[a] <= 0.01 * total / shards else ahead
        want.append((i, min(shards - 1, int(at // (total / shards)))))
        ahead += n
    slots, numbered = Counter(), []
    for i, shard in want:
        numbered.append((i, shard, slots[shard]))
        slots[shard] += 1
    out = shard_by_sampled_splitters(docs.repartition(5), shards=shards).collect()
    assert sorted((r["doc_id"] or -1, r["shard"], r["slot"]) for r in out) == sorted((i or -1, s, k) for i, s, k in numbered)


def test_few_rows_and_none(spark):
    out = check(spark, [(1, "a"), (2, "b")], 40)
    assert len(out) == 2
    assert shard_by_sampled_splitters(spark.createDataFrame([], "doc_id long, text string")).count() == 0
