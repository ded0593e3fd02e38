"""What the operators need from the cluster: shared scratch space, shipped code, deterministic sampling."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import time
import uuid
import weakref
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_TUNED: list[bool] = []
RELEASE_S = 0.5
_RELEASED = [0.0]
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's sources to every executor once per Spark context.

    Executors of a real cluster do not share the driver's folders, and Python
    workers import the functions they run from the package by name.

    Rows of texts go to the workers in batches of about 2 MB, unless the session
    sets a bound of its own: Spark's default is 10,000 rows of any size.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "2m")
    context = spark.sparkContext
    if _SHIPPED.get(context):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="wattline-"), "wattline_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(target)
    _SHIPPED[context] = True


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run`` for a Python worker that other tasks will use after it: what it has freed goes back to the system.

    Freed arrays would otherwise stay with the worker's allocators, and an
    executor keeps a worker for each core beside the memory of its JVM.
    """

    @functools.wraps(run)
    def tidy(batches: Iterator, *settings, **more) -> Iterator:
        try:
            libc = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library: its own ways
            libc = None
        if libc is not None and not _TUNED:
            libc.mallopt(-3, 4 << 20)  # arrays of 4 MB or more are mapped, and unmapped when freed
            _TUNED.append(True)
        try:
            yield from run(batches, *settings, **more)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return tidy


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more; at most every ``RELEASE_S`` seconds."""
    if time.monotonic() - _RELEASED[0] < RELEASE_S:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _RELEASED[0] = time.monotonic()


def _shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="wattline-ckpt-")


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to Parquet files in the shared folder and read again: their order is that of the partitions."""
    spark = session_of(df)
    path = f"{_shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    return spark.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    What earlier plans left behind is released first.

    The folder is the one the session names in ``spark.checkpoint.dir``; a
    folder of our own is set only where a local session names none, as in tests.
    """
    spark = session_of(df)
    release(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_shared_folder(spark))
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Shuffle parallelism the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spare(taken: list[str], *names: str) -> list[str]:
    """Each of ``names``, lengthened until no column of ``taken`` is called so."""
    low = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the column ``key``, a 64-bit name of every row by which its results find it again.

    It is doc_id; for a null id the hash of the text; and where several texts
    share an id, for all of them but the one of the least hash, the hash of id
    and text. Exact repeats of a row share a key.
    """
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    plain = F.coalesce(doc, F.xxhash64(text))
    repeated = docs.select(doc.alias("doc")).where("doc is not null").groupBy("doc").count().where("count > 1").select("doc")
    if repeated.isEmpty():
        return docs.withColumn(key, plain)
    own, least = spare(docs.columns, "_own", "_least")
    firsts = docs.select(doc.alias("doc"), F.xxhash64(text).alias("h")).join(repeated, "doc", "left_semi").groupBy(F.col("doc").alias(own)).agg(F.min("h").alias(least))
    met = docs.join(firsts, doc == F.col(own), "left")
    return met.withColumn(key, F.when(F.col(least) < F.xxhash64(text), F.xxhash64(doc, text)).otherwise(plain)).drop(own, least)


def block(counts: np.ndarray) -> bytes:
    """An array of counts as ``sum_blocks`` takes it; most are zeros and shrink well."""
    return zlib.compress(counts.astype(np.int64).tobytes(), 1)


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int64)


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(_counts(x) for x in table["counts"].to_pylist())
    return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int64()), "counts": pa.array([block(total)], pa.binary())})


def sum_blocks(blocks: DataFrame, fan: int = 64) -> list[tuple[int, np.ndarray]]:
    """(chunk, sum) of the arrays in ``blocks`` (columns chunk, counts; each a ``block``), one sum for each chunk.

    A tree of sums: in each round a task adds about ``fan`` arrays at most,
    until every chunk has one.
    """
    now = checkpointed(blocks.select("chunk", F.spark_partition_id().cast("long").alias("part"), "counts"))
    while (most := now.groupBy("chunk").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // fan)
        spread = now.select("chunk", F.pmod(F.xxhash64("part", F.lit(most)), F.lit(groups)).alias("part"), "counts")
        now = checkpointed(spread.groupBy("chunk", "part").applyInArrow(_add_blocks, "chunk int, part long, counts binary"))
    return [(r["chunk"], _counts(r["counts"])) for r in now.collect()]


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no label may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(*columns: Column, salt: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(salt)), 11).cast("double") / F.lit(float(1 << 53))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
