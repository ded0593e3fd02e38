"""Sharding by sampled splitters, with DataFrame operations only.

A size-weighted sample of the record keys gives quantile boundaries; records
are range-partitioned by them; ranges that turn out overfull are subdivided
by a second, denser sample; running totals over the exact range sizes then
place the shard borders to within a record or a small group of equal texts.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, unit_hash


def _keyed(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    raw = F.col(text_col).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.length(raw), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(raw, F.lit(b""))).alias("a"), F.xxhash64(F.col(id_col).cast("long")).alias("b"),
    )


#: Before all hashes of ids: a range that starts here starts with a text's first copy.
START = -(1 << 63)


def _splitters(rows: list, pieces: int, least: float) -> list[tuple[int, int]]:
    """Quantile keys of a sample in which a row stands for max(size, least) bytes.

    Ranges start between texts, but for a text so common that several splitters
    fall on it: its copies are divided by their ids.
    """
    rows = sorted(((r["a"], r["b"]), max(float(r["size"]), least)) for r in rows)
    seen = sum(w for _, w in rows)
    found, run = [], 0.0
    for key, weight in rows:
        if run * pieces >= (len(found) + 1) * seen:
            found.append(key)
        run += weight
    often = Counter(a for a, _ in found)
    return sorted({(a, b if often[a] > 1 else START) for a, b in found})


def _constant(value: list, kind: str) -> Column:
    """A literal of a nested type, as one constant that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _range_of(splitters: list[tuple[int, int]], key: Column) -> Column:
    """Number of splitters at or below the key, by two levels of about sqrt(n) comparisons each."""
    if not splitters:
        return F.lit(0)
    named = [{"a": a, "b": b} for a, b in splitters]
    step = max(1, round(len(named) ** 0.5))
    heads = named[step - 1 :: step]
    groups = [named[i * step : (i + 1) * step] for i in range(len(heads) + 1)]
    coarse = F.size(F.filter(_constant(heads, "array<struct<a:bigint,b:bigint>>"), lambda s: s <= key))
    fine = F.size(F.filter(F.element_at(_constant(groups, "array<array<struct<a:bigint,b:bigint>>>"), coarse + 1), lambda s: s <= key))
    return (coarse * step + fine).cast("int")


def shard_by_sampled_splitters(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, range_rows: int = 1 << 20, sample_per_range: int = 24, whole: float = 0.01) -> DataFrame:
    """Deal all rows of ``docs`` into ``shards`` runs of the key order, near equal in bytes.

    Columns: doc_id, size (UTF-8 bytes of the text plus ``overhead``), text_crc32,
    law (``bytes``), shard, slot (gapless from 0 within the shard), grown_shard (null).

    The key is (hash of the text, hash of the id), so equal texts are neighbours.
    A group of equal texts that is at most the share ``whole`` of a shard stays
    in one shard; a larger one, which may make up a third of all rows, is divided
    at any of its copies. A shard's bytes so differ from an equal share by less
    than two records and twice that share.

    Texts are read once, for their keys, which are kept in the shared folder. The
    work is divided into ranges of about ``range_rows`` rows, 8 a shard at least
    and 16,384 in all at the most, by splitters out of a size-weighted sample;
    overfull ranges are subdivided by a denser one. At most ``sample_per_range``
    rows a range (in expectation) reach the driver, as fixed-width keys, and one
    total a range.

    A null text counts as no bytes with checksum 0; a null id is a value like
    any other; a very long text is a record like any other; exact repeats of a
    row take neighbouring slots; an empty table gives no rows; other columns of
    ``docs`` are ignored.
    """
    rows = checkpointed(_keyed(docs, id_col, text_col, overhead))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    splitters: list[tuple[int, int]] = []
    totals: dict[int, tuple[int, int]] = {}
    key = F.struct("a", "b")
    if total:
        pieces = max(8 * shards, min(-(-n // range_rows), 16_384))
        least = total / (pieces * sample_per_range)
        drawn = rows.where(unit_hash("a", "b", salt=17) * least < F.col("size"))
        splitters = _splitters(drawn.select("a", "b", "size").collect(), pieces, least)
        for salt in (18, 19):
            placed = rows.select(_range_of(splitters, key).alias("range"), "size", "a", "b")
            totals = {r["range"]: (r["bytes"], r["n"]) for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
            overfull = {k: b / (sample_per_range * -(-b * 2 * pieces // int(2 * total + 1))) for k, (b, m) in totals.items() if b > 2 * total / pieces and m > 1}
            if not overfull or salt == 19:
                break
            needed = F.element_at(F.create_map(*[x for k, v in overfull.items() for x in (F.lit(k), F.lit(v))]), F.col("range"))
            more = placed.where(F.col("range").isin(*overfull)).where(unit_hash("a", "b", salt=salt) * needed < F.col("size")).select("range", "a", "b", "size").collect()
            added = {x for k, small in overfull.items() for x in _splitters([r for r in more if r["range"] == k], max(2, -(-totals[k][0] * pieces // total)), small)}
            splitters = sorted(added.union(splitters))
    before_bytes, before_rows, bytes_run, rows_run = {}, {}, 0, 0
    for k in sorted(totals):
        before_bytes[k], before_rows[k] = bytes_run, rows_run
        bytes_run, rows_run = bytes_run + totals[k][0], rows_run + totals[k][1]
    ends = len(splitters) + 1
    offsets = lambda found: F.element_at(_constant([found.get(k, 0) for k in range(ends)], "array<bigint>"), F.col("range") + 1)
    within, group = Window.partitionBy("range").orderBy("a", "b", "size"), Window.partitionBy("range", "a")
    ranked = rows.withColumn("range", _range_of(splitters, key)).withColumns({
        "rank": offsets(before_rows) + F.row_number().over(within) - 1,
        "ahead": offsets(before_bytes) + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
    })
    grouped = ranked.withColumns({"group_bytes": F.sum("size").over(group), "group_ahead": F.min("ahead").over(group)})
    share = max(total or 1, 1) / shards
    at = F.when(F.col("group_bytes") <= whole * share, F.col("group_ahead")).otherwise(F.col("ahead"))
    dealt = grouped.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at / F.lit(float(share)))).cast("int"))
    firsts = F.broadcast(dealt.groupBy("shard").agg(F.min("rank").alias("first")))  # a row a shard
    return dealt.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
