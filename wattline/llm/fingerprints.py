"""Context-triggered piecewise hashing: fingerprints of texts that stay alike where the texts do, and their likeness."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.runtime import checkpointed, lean, session_of, ship, task_count
from wattline.llm.textkit import U64, buffers, mix, slices, span_hash

#: Bytes that decide on a boundary.
WINDOW = 7
#: A block size is the least power of two that makes a text of so many characters, at one piece a block, no longer than this.
PIECES = 64
#: A piece is two characters of this alphabet: 12 bits.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = [a + b for a in ALPHABET for b in ALPHABET]
_POWERS = [U64(0x9E3779B97F4A7C15**k % 2**64) for k in range(WINDOW)]
TOLD = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LONG = 1 << 20
#: Borders are a constant of the plan.
MOST_RANGES = 1 << 14


def block_size(chars: int) -> int:
    size = 1
    while chars > PIECES * size:
        size *= 2
    return size


def rolling(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the ``WINDOW`` - 1 bytes before it in its text (``starts``: where texts start, but the first)."""
    h = np.zeros(len(data), dtype=U64)
    wide = data.astype(U64) + U64(1)
    for back in range(WINDOW):
        if back >= len(data):
            break
        term = wide[: len(wide) - back] * _POWERS[back]
        for k in range(back):  # bytes of the text before
            hit = starts[(starts + k < len(data))] + k - back
            term[hit[hit >= 0]] = 0
        h[back:] += term
    return mix(h)


def boundaries(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where pieces end: one past each byte whose rolling hash ``sizes`` (a power of two for each text) divides, and each text's end."""
    masks = sizes.astype(U64) - U64(1)
    found = []
    for a in range(0, len(data), LONG):  # a very long text is hashed a part at a time
        b, lead = min(a + LONG, len(data)), min(a, WINDOW - 1)
        first = np.searchsorted(offsets, a, side="right") - 1
        last = np.searchsorted(offsets, b, side="left")
        h = rolling(data[a - lead : b], offsets[max(first, 1) : last] - (a - lead) if last > first else offsets[:0])[lead:]
        own = np.repeat(masks[first:last], np.diff(np.clip(offsets[first : last + 1], a, b)))
        found.append(np.flatnonzero((h & own) == 0) + a + 1)
    ends = offsets[1:][np.diff(offsets) > 0]
    return np.unique(np.concatenate([*found, ends]))


def signatures(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Of each text, two characters for each of its pieces."""
    ends = boundaries(data, offsets, sizes)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
    codes = (span_hash(data, starts, ends) >> U64(52)).astype(np.int64).tolist()
    firsts = np.searchsorted(ends, offsets, side="right")
    pairs = [_PAIRS[c] for c in codes]
    return ["".join(pairs[a:b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]


def fingerprints(texts: list[str]) -> list[str]:
    """"size:signature at this block size:signature at twice the size" of each text."""
    column = pa.array(texts, pa.large_string())
    sizes = np.array([block_size(len(t)) for t in texts], dtype=np.int64)
    found: list[str] = []
    for a, b in slices(column, LONG):
        data, offsets = buffers(column.slice(a, b - a))
        one, two = (signatures(data, offsets, n * sizes[a:b]) for n in (1, 2))
        found.extend(f"{s}:{x}:{y}" for s, x, y in zip(sizes[a:b].tolist(), one, two))
    return found


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table in one integer."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def likeness(one: str, other: str) -> float:
    """1 less the share of pieces that must be inserted or deleted to make one signature the other, at the finest block size that both have; 0 where they have none.

    Fingerprints without any piece are alike among themselves and like no others.
    """
    if one == other:
        return 1.0
    (size, *a), (other_size, *b) = one.split(":"), other.split(":")
    size, other_size = int(size), int(other_size)
    if size == other_size:
        x, y = a[0], b[0]
    elif size == 2 * other_size:
        x, y = a[0], b[1]
    elif other_size == 2 * size:
        x, y = a[1], b[0]
    else:
        return 0.0
    p, q = ([s[i : i + 2] for i in range(0, len(s), 2)] for s in (x, y))
    return 2.0 * common(p, q) / (len(p) + len(q)) if p and q else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@lean
def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows that come in order; of each ``part`` the last row (helper) only follows the others, copies follow themselves."""
    before = None  # the row whose follower has not come yet, with its fingerprint
    spoken: set = set()

    def result(row: dict, print_: str, following: str, next_print: str) -> tuple:
        new = edited(row["text"], following)
        return row["doc_id"], len(row["text"]), hashlib.sha256(new.encode()).hexdigest(), print_, new, likeness(print_, next_print)

    for batch in batches:
        for a, b in slices(batch.column("text")):
            rows = batch.slice(a, b - a).to_pylist()
            for r in rows:
                r["text"] = r["text"] or ""
            prints = fingerprints([r["text"] for r in rows])
            out = []
            for r, p in zip(rows, prints):
                if r["role"] == 2:  # copies of one row
                    out.extend([result(r, p, r["text"], p)] * r["copies"])
                    continue
                if before is not None and before[0]["part"] == r["part"]:
                    out.append(result(*before, r["text"], p))
                before = None if r["role"] == 1 else (r, p)
            news = fingerprints([x[4] for x in out])
            columns = list(zip(*[(i, n, sha, p, q, likeness(p, q), near) for (i, n, sha, p, _, near), q in zip(out, news)])) or [()] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in TOLD.split(", ")])


def _keys(found: list[tuple]) -> Column:
    """Sorted keys as one constant that the optimizer folds."""
    rows = [{"no": no, "doc": doc, "h": h} for no, doc, h in found]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<no: boolean, doc: bigint, h: bigint>>")


def _place(key: Column, least: list) -> Column:
    """How many of the sorted keys ``least`` are at most ``key``: a binary search."""
    steps = [1 << k for k in range(len(least).bit_length() - 1, -1, -1)]
    known = _keys(least)
    inside = lambda p, s: (p + s <= len(least)) & (F.try_element_at(known, (p + s).cast("int")) <= key)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda p, s: F.when(inside(p, s), p + s).otherwise(p))


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness and that to the next document: see ``TOLD``.

    A text is cut where the rolling hash of its last ``WINDOW`` bytes says so;
    its fingerprint has a hash for each piece, at two block sizes that follow from its
    length. The edited text is the first half of a document and as much of the
    next one (ascending doc_id; after the last comes the first).

    Ids and hashes alone are sorted first; they tell the borders of ``parts``
    ranges. Then each text moves once, to its range's task, and the first row of
    a range also to the range before it. Nothing but the borders is broadcast.

    Null texts are empty; an empty text is edited to an empty one. Null ids come last. Rows with
    one id follow one another by the hash of the text; of m exact repeats of a
    row, m - 1 are followed by themselves and one by the next document, and those
    that repeat more often than a range has rows travel once, with their number.
    A single document follows itself; an empty table gives no rows; a text is one value
    in its task, however long, and hashed a part at a time; other columns are ignored.
    """
    spark = session_of(docs)
    ship(spark)
    parts = parts or min(4 * task_count(spark), MOST_RANGES)
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(text).alias("h"))
    narrow = checkpointed(docs.select(key.alias("key")))
    n = narrow.count()
    if n == 0:
        return spark.createDataFrame([], TOLD)
    often = max(1000, n // parts)
    hot = [tuple(r["key"]) for r in narrow.groupBy("key").count().where(F.col("count") > often).collect()]  # fewer than ``parts``
    is_hot = F.lit(False)
    if hot:
        is_hot = F.array_contains(_keys(hot), F.col("key"))
    ranged = narrow.where(~is_hot).unionByName(narrow.where(is_hot).distinct()) if hot else narrow
    borders = ranged.repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.min("key").alias("key")).orderBy("key")
    least = [tuple(r["key"]) for r in borders.collect()]  # a row a range

    keyed = docs.select(doc.alias("doc_id"), text.alias("text"), key.alias("key"))
    one = F.lit(1).cast("long")
    moving = keyed.where(~is_hot).withColumn("copies", one)
    copies = None
    if hot:
        met = checkpointed(keyed.where(is_hot).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies")))
        moving = moving.unionByName(met.select("doc_id", "text", "key", one.alias("copies")))
        run = 1 << 12
        more = met.where("copies > 1").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 2) div {run}"))))
        copies = more.select("doc_id", "text", "key", F.least(F.col("copies") - 1 - F.col("run") * run, F.lit(run)).alias("copies"), F.pmod(F.xxhash64("key", "run"), F.lit(parts)).cast("int").alias("part"), F.lit(2).alias("role"))
    placed = moving.withColumn("at", _place(F.col("key"), least) - 1)
    starts = F.col("key") == F.element_at(_keys(least), F.col("at") + 1)
    own = F.struct(F.col("at").alias("part"), F.lit(0).alias("role"))
    ahead = F.struct(F.pmod(F.col("at") - 1, F.lit(len(least))).alias("part"), F.lit(1).alias("role"))
    dealt = placed.withColumn("to", F.explode(F.when(starts, F.array(own, ahead)).otherwise(F.array(own)))).select("doc_id", "text", "key", "copies", "to.part", "to.role")
    if copies is not None:
        dealt = dealt.unionByName(copies)
    rows = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "role", "key")
    return rows.select("doc_id", "text", "copies", "part", "role").mapInArrow(_told, TOLD)
