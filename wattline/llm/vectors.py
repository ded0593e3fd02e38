"""Shared by the vector searches: usable vectors, sorted blocks of an index, ranked results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, lean, task_count, unit_hash
from wattline.llm.textkit import as_array

BLOCK_ROWS = 1024
BLOCK = "grp int, lo double, hi double, ids binary, keys binary, vecs binary"


def usable(vectors: DataFrame, nonzero: bool) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their dimension.

    Left out: null, empty and non-finite vectors, vectors with a null component,
    those without an id, zero vectors if ``nonzero``, and vectors of another
    dimension than the most frequent one (of several, the least).
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad)
    if nonzero:
        kept = kept.where(F.exists(v, lambda x: x != 0))
    first = kept.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = first["dim"] if first else 0
    return kept.where(F.size("embedding") == dim).withColumnRenamed("embedding", "v"), dim


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(as_array(batch.column("v")).flatten(), dtype=np.float64).reshape(batch.num_rows, dim)


def sample(kept: DataFrame, rows: int, n: int) -> np.ndarray:
    """About ``rows`` of the ``n`` vectors, chosen by a hash of the id."""
    found = kept.where(unit_hash("vec_id", salt=2) * n < rows).orderBy("vec_id").select("v").collect()
    if not found:
        found = kept.orderBy("vec_id").limit(1).select("v").collect()
    return np.array([r["v"] for r in found], dtype=np.float64)


def keyed(kept: DataFrame, key: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], dim: int, change: Callable[[np.ndarray], np.ndarray] = lambda x: x, kind: type = np.float64) -> DataFrame:
    """(grp, key, vec_id, v as bytes) with group and key from ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(change(matrix(batch, dim)))
            group, order = key(x)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(order, pa.float64()), batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["grp", "key", "vec_id", "v"])

    return kept.mapInArrow(run, "grp int, key double, vec_id long, v binary")


def _flush(group: int, rows: list) -> list:
    keys, ids, vecs = zip(*rows)
    return [group, keys[0], keys[-1], np.array(ids, np.int64).tobytes(), np.array(keys).tobytes(), b"".join(vecs)]


@lean
def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows into blocks of one group each; an exact repeat of a row counts once."""

    def batch_of(blocks: list) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks), kinds)], names=["grp", "lo", "hi", "ids", "keys", "vecs"])

    group, rows = None, []
    for batch in batches:
        for g, k, i, v in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "vec_id", "v"))):
            if rows and (g != group or len(rows) >= most):
                if rows[-1] == (k, i, v) and g == group:
                    continue
                yield batch_of([_flush(group, rows)])
                rows = []
            if not (rows and rows[-1] == (k, i, v)):
                rows.append((k, i, v))
            group = g
    if rows:
        yield batch_of([_flush(group, rows)])


def blocks(rows: DataFrame, n: int, most: int = BLOCK_ROWS) -> DataFrame:
    """The index of ``n`` rows: blocks of rows that are neighbours in (group, key, id), kept in the shared folder.

    Range partitions end anywhere between two ids, so one group, or one vector
    with very many copies, spreads over as many partitions as its rows need.
    """
    tasks = min(task_count(rows.sparkSession), max(1, -(-n // most)))
    dealt = rows.repartitionByRange(tasks, "grp", "key", "vec_id").sortWithinPartitions("grp", "key", "vec_id", "v")
    return checkpointed(dealt.mapInArrow(lambda it: _pack(it, most), BLOCK))


def in_parts(asked: DataFrame, index: DataFrame, rows: dict[int, int], part_rows: int = 1 << 15) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by ``grp`` with a further key ``part``: a group's blocks are dealt to a part for each ``part_rows`` of its ``rows``.

    What is asked goes to every part of its group, so a task's share of a join
    does not grow with the group.
    """
    counts = F.create_map(*[F.lit(x) for g, n in rows.items() for x in (int(g), int(max(1, -(-n // part_rows))))])
    many = F.coalesce(F.try_element_at(counts, F.col("grp")), F.lit(1))
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))), index.withColumn("part", F.pmod(F.xxhash64("ids"), many).cast("int"))


def unpack(ids: bytes, vecs: bytes, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vecs, dtype).reshape(len(i), -1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ties to the smaller id: query_id, rank, vec_id, score."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
