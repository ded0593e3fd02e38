"""Centroid clustering in whole numbers, with partial-distance search in place of full distances."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, lean, ship
from wattline.llm.textkit import as_array

BLOCK_ROWS = 8192
#: Components beyond count as these, so whole numbers of 64 bits hold them.
MOST = 1 << 62
#: With components below, squared distances of 64 components stay within 63 bits.
NARROW = 1 << 27
LARGEST = (1 << 63) - 1
BLOCK = "ids array<bigint>, vecs binary"
TOLD = "vec_id long, cluster int, distance long"


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -float(MOST), float(MOST)).astype(np.int64)


def _exact(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """``x`` as it can be subtracted, squared and summed without loss: in 64 bits, or in Python's integers where these do not do."""
    most = max((int(np.abs(a).max(initial=0)) for a in (x, other)), default=0)
    return x if most < NARROW else x.astype(object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and squared distance to it, for every row; ties to the smaller number.

    Dimensions are taken in ``order``, ``step`` at a time. The centroid that is
    nearest in the first ones gives the first whole distance; every other
    centroid is abandoned for a row once its partial sum is above the row's best,
    and those that are never abandoned finish all dimensions.
    """
    kind = _exact(x, centroids).dtype
    x, c = x[:, order].astype(kind), centroids[:, order].astype(kind)
    dims, each = x.shape[1], np.arange(len(x))

    def squares(d: np.ndarray) -> np.ndarray:
        return (d * d).sum(axis=1)

    first = np.stack([squares(x[:, :step] - c[j, :step]) for j in range(len(c))], axis=1)
    label = first.argmin(axis=1)
    seed = label.copy()
    best = first[each, seed] + squares(x[:, step:] - c[seed, step:])
    for j in range(len(c)):
        rows = np.flatnonzero((seed != j) & (first[:, j] <= best))
        partial = first[rows, j]
        for a in range(step, dims, step):
            if len(rows) == 0:
                break
            partial = partial + squares(x[rows, a : a + step] - c[j, a : a + step])
            alive = (partial <= best[rows]).astype(bool)
            rows, partial = rows[alive], partial[alive]
        won = ((partial < best[rows]) | ((partial == best[rows]) & (j < label[rows]))).astype(bool)
        best[rows[won]], label[rows[won]] = partial[won], j
    return label, best


def _unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, raw in zip(batch.column("ids"), batch.column("vecs")):
            yield ids.values, np.frombuffer(raw.as_py(), np.int64).reshape(-1, dim)


def _blocks(kept: DataFrame, dim: int, scale: int) -> DataFrame:
    """The vectors as blocks of whole numbers, in the shared folder; a task's rows stay in its partition, nothing is shuffled."""

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(as_array(batch.column("v")).flatten(), dtype=np.float64)
            x = to_integers(flat, scale).reshape(batch.num_rows, dim)
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                ids = batch.column("vec_id").slice(a, BLOCK_ROWS).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x[a : a + BLOCK_ROWS].tobytes()], pa.binary())], names=["ids", "vecs"])

    return checkpointed(kept.mapInArrow(pack, BLOCK))


def _by_variance(blocks: DataFrame, dim: int) -> np.ndarray:
    """The dimensions from the largest variance to the smallest, over all vectors."""

    @lean
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for _, x in _unpacked(batches, dim):
            y = x.astype(np.float64)
            n, s, q = n + len(y), s + y.sum(axis=0), q + (y * y).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([float(n)] * dim), pa.array(s), pa.array(q)], names=["dim", "n", "s", "q"])

    found = blocks.mapInArrow(moments, "dim int, n double, s double, q double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = {r["dim"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in found.collect() if r["n"]}  # one row a dimension
    return np.array(sorted(range(dim), key=lambda d: (-spread.get(d, 0.0), d)))


def _means(blocks: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact sums of each task meet in Spark, at most clusters x dimensions rows reach the driver."""
    k, dim = centroids.shape

    @lean
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0] * k, np.zeros((k, dim), dtype=object)
        for _, x in _unpacked(batches, dim):
            label, _ = nearest(x, centroids, order)
            y = x if np.abs(x).max(initial=0) < LARGEST // (2 * BLOCK_ROWS) else x.astype(object)
            for j in np.unique(label).tolist():
                own = y[label == j]
                n[j] += len(own)
                total[j] += own.sum(axis=0).astype(object)
        rows = [(j, d, n[j], Decimal(int(total[j, d]))) for j in range(k) if n[j] for d in range(dim)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["cluster", "dim", "n", "total"])

    found = blocks.mapInArrow(sums, "cluster int, dim int, n long, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    new = centroids.copy()
    for r in found.collect():
        new[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return new


def _assigned(blocks: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    dim = centroids.shape[1]

    @lean
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _unpacked(batches, dim):
            label, best = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array([min(int(d), LARGEST) for d in best.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(tell, TOLD)


def cluster_by_centroids(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, on_round: Callable[[int, np.ndarray], None] | None = None) -> DataFrame:
    """Every vector with its cluster: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components are floor(``scale`` * x). Centroids start as the ``k`` vectors of
    the smallest sha256 of "seed:vec_id"; each of ``rounds`` rounds assigns every
    vector to the nearest one and moves each centroid that has vectors to the
    componentwise floor of their mean; then all are assigned once more. Rounds
    end early where a round changes nothing, as all further ones would not either.

    Vectors are read once and kept as blocks in the shared folder; a round is one
    job without a shuffle of vectors.

    Null vectors, those of another length and those with a null or non-finite
    component are left out; a null id is hashed as an empty one; rows that repeat
    are vectors of their own, ties for a first centroid go to the lesser
    vector; with fewer vectors than ``k`` each is a centroid; components beyond
    2^62 count as 2^62, distances and sums beyond 64 bits as the largest number
    of 64 bits; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(v.isNotNull() & (F.size(v) == dim)).where(~bad).withColumnRenamed("embedding", "v")
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = kept.orderBy(told, "v").limit(k).collect()  # k rows
    schema = f"{TOLD}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not chosen:
        return spark.createDataFrame([], schema)
    centroids = to_integers(np.array([r["v"] for r in chosen], dtype=np.float64), scale)
    blocks = _blocks(kept, dim, scale)
    order = _by_variance(blocks, dim)
    for n in range(rounds):
        new = _means(blocks, centroids, order)
        if on_round is not None:
            on_round(n, new)
        if np.array_equal(new, centroids):
            break
        centroids = new
    done = checkpointed(_assigned(blocks, centroids, order))
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a cluster
    whole = min(sum(sums.values()), LARGEST)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    table = spark.createDataFrame([(j, min(s, LARGEST), whole, digest(centroids[j])) for j, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
