"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wattline.llm.runtime import lean, ship, spare, task_count, unit_hash, with_key
from wattline.llm.textkit import as_array, buffers, mix, slices, span_hash

U64 = np.uint64
#: Text whose chunks meet in one bucket: their digests and places take somewhat more.
BUCKET_BYTES = 64 << 20
GEAR = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def gear_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """The gear hash h = (h << 1) + gear[byte] at every byte, started afresh at each text.

    A byte leaves a 64-bit hash after 64 steps and its lowest ``window`` bits
    after ``window`` steps, which are the bits that count here; doubling the
    covered span in each step gives them all at once.
    """
    h = GEAR[data]
    age = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    span = 1
    while span < window:
        moved = np.zeros_like(h)
        moved[span:] = h[:-span] << U64(span)
        moved[age < span] = 0
        h = h + moved
        span *= 2
    return h


def _natural(data: np.ndarray, offsets: np.ndarray, bits: int, window: int, block: int = 1 << 18) -> np.ndarray:
    """Places after which the hash says cut, found a block of bytes at a time."""
    mask = U64(((1 << bits) - 1) << (window - bits))
    out = [np.zeros(0, np.int64)]
    for low in range(0, len(data), block):
        first = max(0, low - window)
        part = data[first : low + block]
        inside = np.clip(offsets - first, 0, len(part))
        hit = (gear_hashes(part, np.concatenate(([0], inside, [len(part)])), window) & mask) == 0
        out.append(np.flatnonzero(hit[low - first :]) + low + 1)
    return np.concatenate(out)


def cut_points(data: np.ndarray, offsets: np.ndarray, bits: int, longest: int, window: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts.

    A chunk ends after a byte where the highest ``bits`` of the gear hash's
    lowest ``window`` bits, which the last bytes up to ``window`` reach, are all
    zero; between characters only, and after ``longest`` bytes at the latest.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fits = np.ones(len(data) + 1, dtype=bool)
    fits[:-1] = (data & 0xC0) != 0x80
    ends = _natural(data, offsets, bits, window)
    ends = np.unique(np.concatenate((ends[fits[ends]], offsets[1:])))
    ends = ends[ends > 0]
    starts = np.concatenate(([0], ends[:-1]))
    long = np.flatnonzero(ends - starts > longest)
    if len(long):
        more = []
        for a, b in zip(starts[long], ends[long]):
            at = a
            while b - at > longest:
                at += longest
                while not fits[at]:
                    at -= 1
                more.append(at)
        ends = np.unique(np.concatenate((ends, np.array(more))))
        starts = np.concatenate(([0], ends[:-1]))
    return starts, ends


def _chunks(texts: pa.Array, bits: int, longest: int) -> tuple[np.ndarray, ...]:
    """text, start and end within it, and digest, of every chunk of a slice of texts."""
    data, offsets = buffers(texts)
    starts, ends = cut_points(data, offsets, bits, longest)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return text, starts - offsets[text], ends - offsets[text], span_hash(data, starts, ends)


@lean
def _digests(batches: Iterator[pa.RecordBatch], bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The distinct digests of each text."""
    for batch in batches:
        texts = as_array(batch.column("text"))
        for a, b in slices(texts):
            text, _, _, digest = _chunks(texts.slice(a, b - a), bits, longest)
            own = np.unique(np.stack((text.astype(U64), digest)), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["digest"])


#: What a packed place stands for: a chunk; the first place of a common digest in a slice; a chunk of a common digest.
CHUNK, LEAD, COMMON = 0, 1, 2


@lean
def _deal(batches: Iterator[pa.RecordBatch], buckets: int, bits: int, longest: int, common: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The chunks of about ``most`` at a time, dealt by digest: one row of packed columns for each bucket.

    Of a digest in ``common`` (sorted) only the first place of these goes to the
    digest's bucket; its chunks, which are known to be repeated, are dealt by
    document, so that no bucket gets them all.
    """
    held, size = [], 0
    for batch in batches:
        docs, texts = np.asarray(batch.column("doc")), as_array(batch.column("text"))
        for a, b in slices(texts):
            text, start, _, digest = _chunks(texts.slice(a, b - a), bits, longest)
            held.append((docs[text + a], start, digest))
            size += len(text)
            if size > most:
                yield _dealt(*(np.concatenate(x) for x in zip(*held)), buckets, common)
                held, size = [], 0
    if size:
        yield _dealt(*(np.concatenate(x) for x in zip(*held)), buckets, common)


def _dealt(doc: np.ndarray, start: np.ndarray, digest: np.ndarray, buckets: int, common: np.ndarray) -> pa.RecordBatch:
    kind = np.full(len(doc), CHUNK, np.uint8)
    bucket = (digest >> U64(40)) % U64(buckets)
    if len(common):
        hot = np.flatnonzero(common[np.minimum(np.searchsorted(common, digest), len(common) - 1)] == digest)
        by = hot[np.lexsort((start[hot], doc[hot], digest[hot]))]
        lead = by[np.concatenate(([True], digest[by][1:] != digest[by][:-1]))] if len(by) else by
        kind[hot] = COMMON
        bucket[hot] = mix(doc[hot].view(U64)) % U64(buckets)
        kind = np.concatenate((kind, np.full(len(lead), LEAD, np.uint8)))
        bucket = np.concatenate((bucket, (digest[lead] >> U64(40)) % U64(buckets)))
        doc, start, digest = (np.concatenate((x, x[lead])) for x in (doc, start, digest))
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1).astype(U64))
    used = np.flatnonzero(np.diff(cuts))
    rows = []
    for i in used:
        at = by[cuts[i] : cuts[i + 1]]
        low = doc[at].min()
        rows.append(np.array([len(at), low], np.int64).tobytes() + digest[at].tobytes() + _planes(doc[at] - low) + _planes(start[at].astype(np.int64)) + kind[at].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "rows"])


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _plain(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(np.int64).ravel()


def _repeated(table: pa.Table) -> pa.Table:
    """Of the chunks in a bucket whose digest occurs twice: per document, the starts, and whether an earlier chunk has it.

    Chunks of common digests count as later ones; a mark of their first place goes out beside.
    """
    parts = []
    for raw in table["rows"].to_pylist():
        n, low = np.frombuffer(raw[:16], np.int64).tolist()
        parts.append((np.frombuffer(raw[16 : 16 + 8 * n], U64), _plain(raw[16 + 8 * n : 16 + 16 * n], n) + low, _plain(raw[16 + 16 * n : 16 + 24 * n], n), np.frombuffer(raw[16 + 24 * n :], np.uint8)))
    digest, doc, start, kind = (np.concatenate(x) for x in zip(*parts))
    known = kind == COMMON
    late = doc[known], (start[known] << 1) | 1
    digest, doc, start, kind = (x[~known] for x in (digest, doc, start, kind))
    by = np.lexsort((start, doc, digest))
    digest, doc, start, kind = digest[by], doc[by], start[by], kind[by]
    later = np.zeros(len(by), dtype=bool)
    later[1:] = digest[1:] == digest[:-1]
    again = later.copy()
    again[:-1] |= later[1:]
    # The first place may stand twice, in exact repeats of a row: these are one.
    same = np.zeros(len(by), dtype=bool)
    same[1:] = later[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(by))))
    first = (doc == doc[lead]) & (start == start[lead])
    marked = np.where(kind == LEAD, first, again & ~same)
    doc, code = np.concatenate((late[0], doc[marked])), np.concatenate((late[1], (start[marked] << 1) | ~first[marked]))
    by = np.lexsort((code, doc))
    doc, code = doc[by], code[by]
    cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return pa.table([pa.array(doc[cuts], pa.int64()), pa.array([c.tobytes() for c in np.split(code, cuts[1:])] if len(cuts) else [], pa.binary())], names=["doc", "marks"])


def _merge(texts: pa.Array, marks: list, bits: int, longest: int, least: int) -> tuple[list, list, list, list]:
    """Per text: spans to remove, bytes in repeated runs, chunks, and the text that stays."""
    spans, repeated, chunks, kept = [], [], [], []
    for lo, hi in slices(texts):
        part = texts.slice(lo, hi - lo)
        text, start, end, _ = _chunks(part, bits, longest)
        cuts = np.searchsorted(text, np.arange(hi - lo + 1))
        for i, value in enumerate(part.to_pylist()):
            a, b = cuts[i], cuts[i + 1]
            chunks.append(int(b - a))
            if value is None or not marks[lo + i]:
                spans.append([])
                repeated.append(0)
                kept.append(value)
                continue
            code = np.concatenate([np.frombuffer(m, np.int64) for m in marks[lo + i]])
            at = np.searchsorted(start[a:b], code >> 1)
            state = np.zeros(b - a + 2, np.int8)
            for later in (1, 0):  # that a place is the first one is the last word
                state[at[(code & 1) == later] + 1] = 1 + later
            s, e = start[a:b], end[a:b]
            runs = []
            for low in (1, 2):
                edge = np.flatnonzero(np.diff((state >= low).astype(np.int8)))
                runs.append([[int(s[x]), int(e[y - 1])] for x, y in zip(edge[::2], edge[1::2]) if e[y - 1] - s[x] >= least])
            total, gone = sum(y - x for x, y in runs[0]), runs[1]
            raw, keep, last = value.encode(), [], 0
            for x, y in gone:
                keep.append(raw[last:x])
                last = y
            spans.append(gone)
            repeated.append(total)
            kept.append(b"".join([*keep, raw[last:]]).decode())
    return spans, repeated, chunks, kept


def _common(narrow: DataFrame, bits: int, longest: int, sample: int, least: int, n: int) -> np.ndarray:
    """Digests that at least ``least`` of about ``sample`` documents have, sorted: they are few, and hold the largest groups."""
    drawn = narrow.where(unit_hash("doc", salt=7) * max(n, 1) < sample)
    found = drawn.dropDuplicates(["doc"]).mapInArrow(lambda it: _digests(it, bits, longest), "digest long").groupBy("digest").count().where(F.col("count") >= least).select("digest").toPandas()
    return np.sort(found["digest"].to_numpy(np.int64).view(U64))


def dedup_substrings(docs: DataFrame, bits: int = 4, longest: int = 512, least_bytes: int = 160, sample: int = 4096, least: int = 16) -> DataFrame:
    """``docs`` with later copies of repeated passages cut out of the texts; adds spans, repeated_bytes and chunks.

    Texts are cut into chunks of about ``2**bits`` bytes where a gear rolling hash
    of the last 16 bytes says so, hence at the same places of a passage wherever
    it stands and whatever was inserted before it. Chunks of equal digest (64
    bits) are equal; the first in the order of (doc_id, place) stays. Single
    chunks repeat by chance, so only runs of neighbouring chunks, ``least_bytes``
    long together, count as passages; runs of chunks that all have earlier copies
    go. A passage is found without the up to about 50 bytes by which its chunks
    fall short of its edges. ``spans`` lists what was cut out as [start, end) in
    UTF-8 bytes, ``repeated_bytes`` the bytes in runs of chunks that occur
    elsewhere, first copies included, and ``chunks`` the number of chunks.
    ``n_chars``, where there is one, is brought up to date.

    Chunks meet in buckets of digests, of about ``BUCKET_BYTES`` of text each at the
    most. Digests that ``least`` of about ``sample``
    documents have, which are few whatever the input, are broadcast: their chunks
    are known to be repeated and only their first places still have to meet.

    A null text stays null and an empty one empty, with no spans and 0 chunks; a
    text may end up empty, its row stays; a very long text is hashed a block at a
    time; the order of a row with a null id, or with an id that another text has
    as well, is that of ``with_key``; exact repeats of a row share their places
    and keep the same text; an empty table gives no rows; other columns pass
    through, ones with the added names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("spans", "repeated_bytes", "chunks")
    key, doc, marked, cut = spare([*docs.columns, "doc", "marks"], "_key", "_doc", "_marks", "_cut")
    rows = with_key(docs, key)
    narrow = rows.select(F.col(key).alias("doc"), "text")
    n, size = narrow.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(4 * task_count(spark), -(-(size or 0) // BUCKET_BYTES))
    common = spark.sparkContext.broadcast(_common(narrow, bits, longest, sample, least, n))
    dealt = narrow.mapInArrow(lambda it: _deal(it, buckets, bits, longest, common.value), "bucket int, rows binary")
    found = dealt.groupBy("bucket").applyInArrow(_repeated, "doc long, marks binary")
    marks = found.groupBy("doc").agg(F.collect_list("marks").alias(marked)).withColumnRenamed("doc", doc)
    met = rows.join(marks.hint("shuffle_hash"), F.col(key) == F.col(doc), "left")

    @arrow_udf("struct<text: string, spans: array<array<bigint>>, repeated_bytes: bigint, chunks: bigint>")
    @lean
    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in columns:
            spans, repeated, chunks, kept = _merge(as_array(texts), lists.to_pylist(), bits, longest, least_bytes)
            values = [pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(repeated, pa.int64()), pa.array(chunks, pa.int64())]
            yield pa.StructArray.from_arrays(values, names=["text", "spans", "repeated_bytes", "chunks"])

    out = met.withColumn(cut, run("text", marked))
    fresh = {"text": F.col(cut)["text"]}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.size(F.col(cut)["spans"]) == 0, F.col("n_chars")).otherwise(F.length(F.col(cut)["text"]).cast(docs.schema["n_chars"].dataType))
    added = [F.col(cut)[c].alias(c) for c in ("spans", "repeated_bytes", "chunks")]
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns], *added)
