"""Line dedup by an exact set-similarity join: prefix, length and positional filters over tokens ordered by rarity."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wattline.llm.filters import bloom, may_hold
from wattline.llm.runtime import block, checkpointed, lean, release, ship, spare, sum_blocks, task_count, with_key
from wattline.llm.textkit import as_array, buffers, has_word, mix, slices, span_hash, word_spans

U64 = np.uint64
RARITY_BITS = 18
CHUNKS = 64
LONG_TEXT = 1 << 20
#: Words of prefixes that meet in one bucket, some 40 bytes each.
BUCKET_WORDS = 2_000_000
FOUND = "xd long, xl int, yd long, yl int, differ int, token long"


def _ceil(share: Fraction, n: np.ndarray) -> np.ndarray:
    """ceil(share * n) in integers."""
    return -((-n.astype(np.int64) * share.numerator) // share.denominator)


def _smallest(share: Fraction) -> Fraction:
    """Two different sets can only be similar enough if both have so many words: n / (n + 1) must reach ``share``."""
    return share / (1 - share) if share < 1 else Fraction(1 << 62)


def _line_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every word; text and line number of every line that has a word."""
    data, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = word_spans(data, offsets)
    if len(starts) == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    # A line with words begins at the last break or start of a text before them.
    breaks = np.flatnonzero(data == 10)
    edges = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    at = np.searchsorted(edges, starts, side="right")
    first = np.ones(len(starts), dtype=bool)
    first[1:] = at[1:] != at[:-1]
    begin = starts[first]
    text = np.searchsorted(offsets, begin, side="right") - 1
    number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[text])
    return span_hash(data, starts, ends), np.cumsum(first) - 1, text, number


def _distinct(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word hashes of each line, sorted, and their lines; ``line`` does not fall."""
    by = np.argsort((line.astype(U64) << U64(32)) | (words >> U64(32)))
    found, at = words[by], line[by]
    new = np.ones(len(by), dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    new[1:] |= at[1:] != at[:-1]
    kept = found[new]
    if ((kept[1:] >> U64(32)) == (kept[:-1] >> U64(32))).any():  # perhaps words of one line that share their upper halves
        by = np.lexsort((words, line))
        found, at = words[by], line[by]
        new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
        kept = found[new]
    return kept, at[new]


def _parts(docs: np.ndarray, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """Keys, texts and the number of the first line of each slice; a very long text comes in parts, cut between lines."""
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        if b - a > 1 or (pc.binary_length(part)[0].as_py() or 0) <= LONG_TEXT:
            yield docs[a:b], part, 0
            continue
        data, _ = buffers(part)
        cuts = np.flatnonzero(data == 10)
        at = line = 0
        while at < len(data):
            near = int(np.searchsorted(cuts, at + LONG_TEXT - 1, side="right")) - 1
            if near < line:  # this line alone is longer
                near = line
            end = int(cuts[near]) + 1 if near < len(cuts) else len(data)
            yield docs[a:b], pa.array([data[at:end].tobytes().decode()]), line
            at, line = end, near + 1


@lean
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one pass over the texts: rows (n, heads, tokens), one for each slice of texts, and rows (chunk, counts).

    A slice's row holds the places of its ``n`` lines that have words, what
    tells their word sets apart (``HEADS``), and the sorted distinct words of
    each, by 32 bits of their hashes: enough to meet by. What tells sets apart
    rests on all 64 bits. The partition's word counts, by hash bucket, come at the end.
    """
    names, kinds = ["n", "heads", "tokens", "chunk", "counts"], [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    totals, waiting, held = np.zeros(1 << RARITY_BITS, np.int64), [], 0
    for batch in batches:
        for docs, texts, first_line in _parts(np.asarray(batch.column("doc")), as_array(batch.column("text"))):
            words, line, text, number = _line_words(texts)
            if len(text) == 0:
                continue
            waiting.append((words >> U64(64 - RARITY_BITS)).astype(np.int32))
            held += len(words)
            if held > len(totals):
                totals += np.bincount(np.concatenate(waiting), minlength=len(totals))
                waiting, held = [], 0
            words, k = _distinct(words, line)
            token = (words >> U64(32)).astype(np.uint32)
            firsts = np.searchsorted(k, np.arange(len(text)))
            hashed = mix(words + U64(0xA5A5A5A5A5A5A5A5))
            half, bit = (hashed >> U64(57)) & U64(1), U64(1) << (hashed >> U64(58))
            bits, bits2 = (np.bitwise_xor.reduceat(np.where(half == U64(x), bit, U64(0)), firsts) for x in (0, 1))
            heads = (docs[text], (number + first_line).astype(np.uint32), np.diff(np.append(firsts, len(k))).astype(np.uint32), np.add.reduceat(hashed, firsts), bits, bits2)
            row = [len(text), b"".join(np.ascontiguousarray(h).tobytes() for h in heads), token.tobytes(), None, None]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)
    totals += np.bincount(np.concatenate([np.zeros(0, np.int32), *waiting]), minlength=len(totals))
    rows = [[None, None, None, i, block(c)] for i, c in enumerate(np.split(totals, CHUNKS)) if c.any()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=names)


#: Of each line: its place, its number of words, a digest and a parity bitmap of 128 bits of its word set.
HEADS = (("doc", np.int64), ("line", np.uint32), ("n", np.uint32), ("a", np.uint64), ("bits", np.uint64), ("bits2", np.uint64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """What ``_scan`` has kept of each slice: its heads, where each line's words start (one more entry), and the words."""
    for batch in batches:
        for n, heads, tokens in zip(*(batch.column(c).to_pylist() for c in ("n", "heads", "tokens"))):
            at, out = 0, {}
            for name, kind in HEADS:
                width = np.dtype(kind).itemsize * n
                out[name] = np.frombuffer(heads[at : at + width], kind)
                at += width
            yield out, np.concatenate(([0], np.cumsum(out["n"], dtype=np.int64))), np.frombuffer(tokens, np.uint32)


@lean
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc, line): the digest of 128 bits of each distinct word set of a document, and its first line there."""
    last, seen = None, set()
    for h, _, _ in _slices(batches):
        b = mix(h["bits"] * U64(0x9E3779B97F4A7C15) + mix(h["bits2"] + h["n"]))
        by = np.lexsort((h["line"], h["doc"], b, h["a"]))
        keep = np.ones(len(by), dtype=bool)
        keep[1:] = np.logical_or.reduce([x[by][1:] != x[by][:-1] for x in (h["a"], b, h["doc"])])
        by = by[keep]
        if h["doc"][0] != h["doc"][-1]:
            last, seen = None, set()
        else:  # maybe a part of a long text, of which the part before came just now
            if last != h["doc"][0]:
                last, seen = h["doc"][0], set()
            own = list(zip(h["a"][by].tolist(), b[by].tolist()))
            by = by[[x not in seen for x in own]]
            seen.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(h["a"][by].view(np.int64)), pa.array(b[by].view(np.int64)), pa.array(h["doc"][by]), pa.array(h["line"][by].astype(np.int32))], names=["a", "b", "doc", "line"])


@lean
def _word_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, lines): the number of lines with words, of each document of a slice."""
    for h, _, _ in _slices(batches):
        doc, n = np.unique(h["doc"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n)], names=["doc", "lines"])


def rarity(scan: DataFrame) -> tuple[np.ndarray, int]:
    """For each word-hash bucket, 0 (rarest) to 255 by the logarithm of its count over all documents; and the number of all words."""
    counts = np.zeros((CHUNKS, (1 << RARITY_BITS) // CHUNKS), np.int64)
    for chunk, total in sum_blocks(scan.where("chunk is not null")):
        counts[chunk] = total
    return np.minimum(255, np.round(8 * np.log2(1 + counts.ravel()))).astype(np.uint8), int(counts.sum())


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, so that small numbers shrink in the shuffle."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _whole(raw: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(kind).ravel()


FIELDS = (("token", np.uint32), ("set", np.uint32), ("bits", np.uint64), ("bits2", np.uint64), ("doc", np.int64), ("line", np.uint32), ("n", np.uint32), ("pos", np.uint32))


@lean
def _postings(batches: Iterator[pa.RecordBatch], order: np.ndarray, buckets: int, share: Fraction, flags: np.ndarray | None, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The prefix tokens of every line (with ``flags``, the flagged ones of them), dealt by token: one row of packed columns for each bucket.

    Of lines with one word set the earliest of a slice alone is posted.
    """
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        full = {k: np.concatenate([h[k] for h in held]) for k, _ in FIELDS}
        bucket = full["token"] % np.uint32(buckets)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        full = {k: v[by] for k, v in full.items()}
        rows = []
        for i in used:
            part = slice(cuts[i], cuts[i + 1])
            low = full["doc"][part].min()
            body = b"".join(_planes(full[k][part] if k != "doc" else full[k][part] - low) for k, _ in FIELDS)
            rows.append(np.array([cuts[i + 1] - cuts[i], low], np.int64).tobytes() + body)
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "rows"])

    least = _smallest(share)
    for h, firsts, tokens in _slices(batches):
        able = h["n"].astype(np.int64) * least.denominator >= least.numerator
        if flags is not None:
            able &= np.add.reduceat(may_hold(flags, tokens), firsts[:-1]) > 0
        by = np.lexsort((h["line"], h["doc"], h["bits2"], h["bits"], h["a"]))
        new = np.ones(len(by), dtype=bool)
        new[1:] = np.logical_or.reduce([h[x][by][1:] != h[x][by][:-1] for x in ("a", "bits", "bits2")])
        lines = np.sort(by[new])
        lines = lines[able[lines]]
        if len(lines) == 0:
            continue
        n = h["n"][lines].astype(np.int64)
        ends = np.cumsum(n)
        k = np.repeat(np.arange(len(lines)), n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n)
        token = tokens[np.repeat(firsts[lines], n) + at]
        key = np.sort((k.astype(U64) << U64(40)) | (order[token >> np.uint32(32 - RARITY_BITS)].astype(U64) << U64(32)) | token)
        keep = at <= (n - _ceil(share, n))[k]
        if flags is not None:
            keep &= may_hold(flags, key.astype(np.uint32))
        at, key, k = at[keep], key[keep], k[keep]
        of = lines[k]
        held.append({"token": key.astype(np.uint32), "set": (h["a"][of] >> U64(32)).astype(np.uint32), "bits": h["bits"][of], "bits2": h["bits2"][of], "doc": h["doc"][of], "line": h["line"][of], "n": h["n"][of], "pos": at.astype(np.uint32)})
        size += len(at)
        if size > most:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _unpacked(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A bucket's postings, in the order of (token, n), one for each set and token: that of its earliest place. Second: the places' ranks."""
    parts: dict[str, list] = {k: [] for k, _ in FIELDS}
    for raw in table["rows"].to_pylist():
        n, low = np.frombuffer(raw[:16], np.int64).tolist()
        at = 16
        for k, kind in FIELDS:
            width = np.dtype(kind).itemsize * n
            parts[k].append(_whole(raw[at : at + width], kind, n) + (low if k == "doc" else kind(0)))
            at += width
    q = {k: np.concatenate(v) for k, v in parts.items()}
    by = np.lexsort((q["line"], q["doc"]))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (q["doc"][by][1:] != q["doc"][by][:-1]) | (q["line"][by][1:] != q["line"][by][:-1])
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    # Equal sets of a token are neighbours in the order of a hash, and the sort, which keeps their order, begins with the earliest.
    where = (q["token"].astype(U64) << U64(32)) | q["n"]
    names = mix(where ^ mix(q["bits"] ^ mix(q["bits2"] + q["set"])))
    by = by[np.argsort(names[by], kind="stable")]
    q = {k: v[by] for k, v in q.items()}
    same = np.zeros(len(by), dtype=bool)
    same[1:] = np.logical_and.reduce([q[k][1:] == q[k][:-1] for k in ("token", "n", "set", "bits", "bits2")])
    kept = np.flatnonzero(~same)
    kept = kept[np.argsort(where[by[kept]], kind="stable")]
    return {k: v[kept] for k, v in q.items()}, place[by[kept]]


def _survivors(q: dict[str, np.ndarray], place: np.ndarray, share: Fraction, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of postings with a common token that pass the length, positional and bitmap filters.

    Third: how far the bitmaps differ, at most the size of the symmetric difference.
    """
    m = len(place)
    n, pos = q["n"].astype(np.int64), q["pos"].astype(np.int64)
    left = n - pos
    token = q["token"].astype(U64) << U64(32)
    longest = np.minimum((n * share.denominator) // share.numerator, 0xFFFFFFFF)
    end = np.searchsorted(token | q["n"].astype(U64), token | longest.astype(U64), side="right")
    both = share / (1 + share)
    # The shorter side of a pair meets the longer one in its mid-prefix.
    count = np.where(pos <= n - _ceil(2 * both, n), end - np.arange(m) - 1, 0)
    cum = np.concatenate(([0], np.cumsum(count)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    first = 0
    while first < m:
        last = max(first + 1, int(np.searchsorted(cum, cum[first] + chunk, side="right")) - 1)
        size = count[first:last]
        i = np.repeat(np.arange(first, last), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(cum[first:last] - cum[first], size)
        first = last
        sizes = n[i] + n[j]
        need = _ceil(both, sizes)
        # The bitmaps' halves one after the other: the first alone rules out most pairs.
        most = sizes - 2 * need
        differ = np.bitwise_count(q["bits"][i] ^ q["bits"][j])
        ok = np.flatnonzero((differ <= most) & (np.minimum(left[i], left[j]) >= need))
        i, j, most = i[ok], j[ok], most[ok]
        differ = differ[ok].astype(np.int64) + np.bitwise_count(q["bits2"][i] ^ q["bits2"][j])
        ok = differ <= most
        i, j, differ = i[ok], j[ok], differ[ok]
        later = place[i] > place[j]
        found.append((np.where(later, i, j), np.where(later, j, i), differ))
    return tuple(np.concatenate(c) for c in zip(*found))


def _candidates(table: pa.Table, share: Fraction, only: np.ndarray | None) -> pa.Table:
    """Rows (line x, earlier line y, how far their bitmaps differ) of the bucket.

    Without ``only``, the likeliest earlier line of each line, and for each line
    that has several, with y null, the tokens at which it meets them. With
    ``only``, all earlier lines of the flagged lines.
    """
    q, place = _unpacked(table)
    x, y, differ = _survivors(q, place, share)
    if only is not None:
        ask = may_hold(only, _slot(q["doc"][x], q["line"][x]))
        x, y, differ = x[ask], y[ask], differ[ask]
    by = np.lexsort((place[y], differ, place[x]))
    x, y, differ = x[by], y[by], differ[by]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (place[x][1:] != place[x][:-1]) | (place[y][1:] != place[y][:-1])
    first = np.ones(len(x), dtype=bool)
    first[1:] = place[x][1:] != place[x][:-1]
    keep, extra = new, np.zeros(0, np.int64)
    if only is None:
        keep = first
        several = np.bincount(place[x[new]], minlength=int(place.max(initial=0)) + 1) > 1
        meets = x[several[place[x]]]
        _, once = np.unique(np.stack((place[meets], q["token"][meets].astype(np.int64))), axis=1, return_index=True)
        extra = meets[once]
    every = np.concatenate((x[keep], extra))
    none = np.arange(len(every)) >= keep.sum()
    tail = np.zeros(len(extra), np.int64)
    columns = [pa.array(q["doc"][every]), pa.array(q["line"][every].astype(np.int32)), pa.array(np.concatenate((q["doc"][y[keep]], tail)), mask=none), pa.array(np.concatenate((q["line"][y[keep]], tail)).astype(np.int32), mask=none)]
    return pa.table([*columns, pa.array(np.concatenate((differ[keep], tail)).astype(np.int32)), pa.array(q["token"][every].astype(np.int64))], names=["xd", "xl", "yd", "yl", "differ", "token"])


def _slot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(U64)) + line.astype(U64))


@lean
def _place_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(np.asarray(batch.column("doc")), np.asarray(batch.column("line")))).view(np.int64))], names=["h"])


def _marked(places: DataFrame) -> np.ndarray:
    """The filter of (doc, line) places."""
    return bloom(places.mapInArrow(_place_hashes, "h long"), places.count())


@lean
def _fetch(batches: Iterator[pa.RecordBatch], flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The word sets, by 64 bits a word and sorted, of the lines whose places are marked, from the texts themselves."""
    for batch in batches:
        for docs, texts, first_line in _parts(np.asarray(batch.column("doc")), as_array(batch.column("text"))):
            data, offsets = buffers(texts)
            breaks = np.flatnonzero(data == 10)
            begin = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
            # An empty text begins where the next does: its one line is empty.
            begin = begin[np.concatenate((begin[1:] != begin[:-1], [True]))] if len(begin) else begin
            begin = begin[begin < len(data)]
            text = np.searchsorted(offsets, begin, side="right") - 1
            number = np.searchsorted(breaks, begin) - np.searchsorted(breaks, offsets[text]) + first_line
            pick = np.flatnonzero(may_hold(flags, _slot(docs[text], number)))
            if len(pick) == 0:
                continue
            end = np.minimum(np.append(begin[1:], len(data))[pick], offsets[text[pick] + 1])
            raw = data.tobytes()
            words, line, of, _ = _line_words(pa.array([raw[x:y].removesuffix(b"\n").decode() for x, y in zip(begin[pick].tolist(), end.tolist())], pa.string()))
            if len(of) == 0:
                continue
            words, line = _distinct(words, line)
            cuts = np.searchsorted(line, np.arange(len(of) + 1))
            sets = [words[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
            at = pick[of]
            yield pa.RecordBatch.from_arrays([pa.array(docs[text[at]]), pa.array(number[at].astype(np.int32)), pa.array(sets, pa.binary())], names=["doc", "line", "words"])


@lean
def _verify(batches: Iterator[pa.RecordBatch], share: Fraction) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("xw").to_pylist(), batch.column("yw").to_pylist()):
            a, b = np.frombuffer(x, U64), np.frombuffer(y, U64)
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            ok.append(common * share.denominator >= share.numerator * (len(a) + len(b) - common))
        yield batch.select(["xd", "xl"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, texts: DataFrame, share: Fraction) -> DataFrame:
    """(xd, xl) of the pairs whose word sets, as a whole, are similar enough."""
    x, y = (F.struct(F.col(f"{k}d").alias("doc"), F.col(f"{k}l").alias("line")) for k in "xy")
    flags = pairs.sparkSession.sparkContext.broadcast(_marked(pairs.select(F.explode(F.array(x, y)).alias("p")).select("p.*")))
    # Written down: joins of plain tables can be split where one line is in many pairs.
    sets = checkpointed(texts.mapInArrow(lambda it: _fetch(it, flags.value), "doc long, line int, words binary").dropDuplicates(["doc", "line"]))
    both = pairs.join(sets.withColumnsRenamed({"doc": "xd", "line": "xl", "words": "xw"}), ["xd", "xl"]).join(sets.withColumnsRenamed({"doc": "yd", "line": "yl", "words": "yw"}), ["yd", "yl"])
    return checkpointed(both.select("xd", "xl", "xw", "yw").mapInArrow(lambda it: _verify(it, share), "xd long, xl int").distinct())


def _similar(kept: DataFrame, texts: DataFrame, order: np.ndarray, words: int, share: Fraction) -> DataFrame:
    """(xd, xl): the lines that have an earlier line of similarity ``share`` or more but another word set; ``words`` is the number of all words."""
    spark = kept.sparkSession
    held = spark.sparkContext.broadcast(order)
    # A prefix has a good 1 - share of a line's words; a bucket is to hold so many of them, whatever the input.
    buckets = int(max(4 * task_count(spark), words * (1 - share) // BUCKET_WORDS + 1))
    posted = kept.mapInArrow(lambda it: _postings(it, held.value, buckets, share, None), "bucket int, rows binary")
    met = checkpointed(posted.groupBy("bucket").applyInArrow(lambda t: _candidates(t, share, None), FOUND))
    each = met.where("yd is not null").groupBy("xd", "xl").agg(F.min(F.struct("differ", "yd", "yl")).alias("best"), F.count_distinct(F.struct("yd", "yl")).alias("n"))
    best = checkpointed(each.select("xd", "xl", "best.yd", "best.yl", (F.col("n") > 1).alias("several")))
    gone = _verified(best.drop("several"), texts, share)
    # Lines with other candidates than the one that failed: all of these, found again at the lines' own tokens.
    more = met.where("yd is null").select("xd", "xl").union(best.where("several").select("xd", "xl")).distinct()
    unsure = checkpointed(more.join(gone, ["xd", "xl"], "left_anti"))
    if unsure.isEmpty():
        return gone
    tokens = checkpointed(met.join(unsure, ["xd", "xl"], "left_semi").select(F.col("token").alias("h")).distinct())
    only = _marked(unsure.select(F.col("xd").alias("doc"), F.col("xl").alias("line")))
    flags = spark.sparkContext.broadcast((only, bloom(tokens, tokens.count())))
    del posted, met, tokens
    posted = kept.mapInArrow(lambda it: _postings(it, held.value, buckets, share, flags.value[1]), "bucket int, rows binary")
    found = posted.groupBy("bucket").applyInArrow(lambda t: _candidates(t, share, flags.value[0]), FOUND).select("xd", "xl", "yd", "yl").distinct()
    pairs = checkpointed(found.join(unsure, ["xd", "xl"], "left_semi").join(best.select("xd", "xl", "yd", "yl"), ["xd", "xl", "yd", "yl"], "left_anti"))
    del posted, found
    return checkpointed(gone.unionByName(_verified(pairs, texts, share)).distinct())


def kept_lines(docs: DataFrame, key: str, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc, lines, stay): for the keys of which a line goes, the number of lines with words, and those of them that stay.

    Lines are numbered from 0. ``docs`` has the columns ``key`` and text.
    """
    ship(docs.sparkSession)
    scan = checkpointed(docs.select(F.col(key).alias("doc"), "text").mapInArrow(_scan, "n int, heads binary, tokens binary, chunk int, counts binary"))
    kept = scan.where("n is not null").select("n", "heads", "tokens")
    order, words = rarity(scan)
    near = _similar(kept, docs.select(F.col(key).alias("doc"), "text"), order, words, threshold)
    # The first line of each word set stays unless it is near an earlier one; all others of that set go.
    sets = kept.mapInArrow(_digests, "a long, b long, doc long, line int")
    firsts = sets.groupBy("a", "b").agg(F.min_by("line", "doc").alias("line"), F.min("doc").alias("doc"))
    stay = firsts.select("doc", "line").join(near.withColumnsRenamed({"xd": "doc", "xl": "line"}), ["doc", "line"], "left_anti")
    # Exact repeats of a row add up their counts: such rows are then looked at though all their lines may stay.
    lines = kept.mapInArrow(_word_lines, "doc long, lines long")
    both = stay.select("doc", "line", F.lit(None).cast("long").alias("lines")).unionByName(lines.select("doc", F.lit(None).cast("int").alias("line"), "lines"))
    found = both.groupBy("doc").agg(F.sum("lines").alias("lines"), F.collect_set("line").alias("stay"))
    return checkpointed(found.where(F.size("stay") < F.col("lines")))


def _without(texts: pa.Array, stay: pa.Array) -> pa.Array:
    """struct(text, removed): each text without its lines with words that are not listed in ``stay``; null ``stay`` keeps all."""
    texts, stay = as_array(texts), as_array(stay)
    out: list[pa.Array] = []
    for a, b in slices(texts):
        part, lists = texts.slice(a, b - a), stay.slice(a, b - a)
        data, offsets = buffers(part)
        breaks = np.flatnonzero(data == 10)
        # Lines start where texts do and after line feeds.
        begin = np.concatenate((offsets[:-1], breaks + 1))
        text = np.concatenate((np.arange(b - a), np.searchsorted(offsets, breaks, side="right") - 1))
        order = np.lexsort((begin, text))
        begin, text = begin[order], text[order]
        first = np.searchsorted(text, np.arange(b - a + 1))
        number = np.arange(len(begin)) - first[text]
        last = np.ones(len(begin), dtype=bool)
        last[:-1] = text[1:] != text[:-1]
        end = np.where(last, offsets[text + 1], np.append(begin[1:], 0) - 1)
        words = np.concatenate(([0], np.cumsum(has_word(data))))
        asked = np.asarray(pc.is_valid(lists))[text]
        named = np.zeros(len(begin), dtype=bool)
        of = np.repeat(np.arange(b - a), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        named[first[of] + np.asarray(lists.flatten(), dtype=np.int64)] = True
        gone = asked & ~named & (words[end] > words[begin])
        alter = np.zeros(b - a, dtype=bool)
        alter[text[gone]] = True
        values = part if not alter.any() else part.to_pylist()
        raw = data.tobytes() if alter.any() else b""
        for i in np.flatnonzero(alter).tolist():
            rows = np.arange(first[i], first[i + 1])[~gone[first[i] : first[i + 1]]]
            values[i] = b"\n".join(raw[x:y] for x, y in zip(begin[rows].tolist(), end[rows].tolist())).decode()
        sizes = np.concatenate(([0], np.cumsum(np.bincount(text[gone], minlength=b - a))))
        removed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(number[gone], pa.int32()))
        out.append(pa.StructArray.from_arrays([pa.array(values, pa.string()) if alter.any() else part.cast(pa.string()), removed], names=["text", "removed"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("text", pa.string()), ("removed", pa.list_(pa.int32()))]))


def remove_repeated_lines(docs: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` with, in every text, the lines taken out that match an earlier line; adds ``removed``.

    Lines are separated by line feeds. Two lines match if the Jaccard similarity
    of their word sets (lower-cased runs of ASCII letters and digits and
    non-ASCII characters) is at least ``threshold``. Lines stand in the order of
    (doc_id, line number); a line goes if any earlier line, kept or not, matches
    it, whether in the same document or another. ``removed`` is the array of the
    numbers of the lines taken out, in order, and ``n_chars``, where there is
    one, is brought up to date.

    The texts are read once for their lines' word sets, which are kept packed in
    the shared folder, again for the lines in candidate pairs, and once to take
    lines out. Word rarity comes from counts
    of all words in ``2**18`` hash buckets, which is what is broadcast. Lines of
    different word sets meet at the tokens of their prefixes, one group a bucket
    of tokens; survivors of the length, positional and bitmap filters are
    verified on whole word sets, taken from the texts again: the likeliest
    candidate of each line first, then all others of the lines that it did not
    match. Lines meet by 32 bits of their words' hashes; they are told apart, and
    verified, by all 64.

    Lines without words always stay; a null text stays null and an empty one
    empty; a document may end up empty, its row stays; a very long text is
    handled in parts of about 1 MB, cut between lines; the order of a row with a
    null id, or with an id that another text has as well, is that of
    ``with_key``; exact repeats of a row, which share their places, keep the
    same lines; an empty table gives no rows; other columns pass through, ones
    called ``removed`` are replaced.
    """
    docs = docs.drop("removed")
    key, doc, stay, cut = spare([*docs.columns, "lines"], "_key", "_doc", "_stay", "_cut")
    rows = with_key(docs, key)
    found = kept_lines(rows, key, threshold).select(F.col("doc").alias(doc), F.col("stay").alias(stay))
    release(docs.sparkSession)

    @arrow_udf("struct<text: string, removed: array<int>>")
    @lean
    def without(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in columns:
            yield _without(texts, lists)

    met = rows.join(found.hint("shuffle_hash"), F.col(key) == F.col(doc), "left").withColumn(cut, without("text", stay))
    changed = F.size(F.col(cut)["removed"]) > 0
    fresh = {"text": F.col(cut)["text"]}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(changed, F.length(F.col(cut)["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return met.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns], F.col(cut)["removed"].alias("removed"))
