"""Near-duplicate documents by DartMinHash over weighted word shingles, banded joining and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.filters import bloom, may_hold
from wattline.llm.graph import components
from wattline.llm.runtime import checkpointed, lean, ship, spare, with_key
from wattline.llm.textkit import as_array, mix, shingle_hashes, slices, word_hashes

U64 = np.uint64
LOWEST = -1
GROUP_ROWS = 4096
GROUP_BYTES = 8 << 20
_POISSON: dict[int, np.ndarray] = {}


def _cumulative(level: int) -> np.ndarray:
    """Poisson probabilities, summed, for the number of darts in an area of 2**level."""
    if level not in _POISSON:
        mean = 2.0**level
        k = np.arange(1, int(mean + 12 * mean**0.5 + 20))
        _POISSON[level] = np.cumsum(np.exp(np.concatenate(([0.0], np.cumsum(np.log(mean / k)))) - mean))
    return _POISSON[level]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def dart_minhash(ids: np.ndarray, starts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (sets x ``k``) of weighted sets; elements weigh 1 where ``weights`` (positive, not only whole) is not given.

    Every element has a plane of weight and rank, on which darts fall as a
    Poisson process of one dart a unit of area, drawn from the element's own hash
    and therefore alike in every set that has it. A set gets the darts that land
    below the element's weight in it. Each dart also names one of ``k``
    coordinates, and a coordinate's value is its dart of lowest rank among all
    elements: two sets agree in it with the probability of their weighted
    Jaccard similarity.

    The planes are cut into areas that double in weight, [2**v - 1, 2**(v+1) - 1),
    and in rank. Ranks are visited from the lowest until all coordinates of a set
    are hit, so a set takes about k ln k darts, and an element of weight w
    log2(w + 1) areas of a rank, whatever the weights add up to.
    """
    n = len(starts) - 1
    value, hit = np.full(n * k, ~U64(0)), np.zeros(n * k, dtype=bool)
    owner = np.repeat(np.arange(n), np.diff(starts))
    weights = np.ones(len(ids)) if weights is None else weights
    areas = np.maximum(1, np.ceil(np.log2(weights + 1))).astype(np.int64)
    which = np.repeat(np.arange(len(ids)), areas)
    v = np.arange(len(which)) - np.repeat(np.cumsum(areas) - areas, areas)
    ids, owner, weights = mix(ids[which] + v.astype(U64) * U64(0xA24BAED4963EE407)), owner[which], weights[which]
    level = LOWEST - 1
    while len(ids):
        level += 1
        # The first ranks reach from 0 to 2**LOWEST; the next ones double the reach.
        height = LOWEST if level == LOWEST else level - 1
        step = level - LOWEST
        u = _unit(mix(ids + U64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
        count = np.zeros(len(ids), np.int64)
        for width in np.unique(v).tolist():
            mine = np.flatnonzero(v == width)
            count[mine] = np.searchsorted(_cumulative(width + height), u[mine], side="right")
        of = np.repeat(np.arange(len(ids)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(mix(ids[of] ^ U64((step + 77) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) + nth.astype(U64) * U64(0x8CB92BA72F3D8DD7))
        # An area below an element's weight is all its own; of the last one, what lies below the weight.
        tall = np.exp2(v[of])
        partly = np.flatnonzero(2 * tall - 1 > weights[of])
        inside = np.ones(len(of), dtype=bool)
        inside[partly] = tall[partly] * (1 + _unit(mix(dart[partly] + U64(0x632BE59BD9B4E019)))) - 1 < weights[of[partly]]
        dart, of = dart[inside], of[inside]
        slot = owner[of] * k + ((dart >> U64(32)) % U64(k)).astype(np.int64)
        fresh = ~hit[slot]
        np.minimum.at(value, slot[fresh], mix(dart[fresh] ^ U64(0x2545F4914F6CDD1D)))  # a dart's rank among those of its height, and its name
        hit[slot] = True
        keep = ~hit.reshape(n, k).all(axis=1)[owner]
        ids, owner, weights, v = ids[keep], owner[keep], weights[keep], v[keep]
    return value.reshape(n, k)


def weighted(shingles: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by 48 bits or so of their hashes, where each text's start, and how often each occurs there."""
    n = len(starts) - 1
    bits = U64(64 - max(16, n.bit_length()))
    key = np.sort((np.repeat(np.arange(n, dtype=U64), np.diff(starts)) << bits) | (shingles >> (U64(64) - bits)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    firsts = np.searchsorted(key[at] >> bits, np.arange(n + 1, dtype=U64))
    return key[at] & ((U64(1) << bits) - U64(1)), firsts, np.diff(np.append(at, len(key))).astype(float)


def regions(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each occurrence of a shingle in its text by a name of its own: (shingle, number of earlier occurrences)."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).astype(U64)
    key = mix(shingles + owner * U64(0xA0761D6478BD642F))
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(shingles)
    out[order] = mix(shingles[order] + nth.astype(U64) * U64(0xE7037ED1A0B428DB))
    return out


@lean
def _sketches(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(doc, n, a, b, sig): number of shingles, digest of the words in order, signature of 32 bits a coordinate."""
    for batch in batches:
        docs, texts = np.asarray(batch.column("doc")), as_array(batch.column("text"))
        for lo, hi in slices(texts):
            words, firsts, n = word_hashes(texts.slice(lo, hi - lo))
            at = (np.arange(len(words)) - np.repeat(firsts[:-1], np.diff(firsts))).astype(U64)
            run = [np.concatenate((np.zeros(1, U64), np.cumsum(mix(words + at * U64(c)), dtype=U64))) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            a, b = (r[firsts[1:]] - r[firsts[:-1]] for r in run)
            shingles, starts = shingle_hashes(words, firsts, width)
            ids, firsts, weights = weighted(shingles, starts)
            sig = (dart_minhash(ids, firsts, k, weights) & U64(0xFFFFFFFF)).astype(np.uint32)
            counts = np.diff(starts)
            yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array(counts, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([s.tobytes() if c else None for s, c in zip(sig, counts)], pa.binary())], names=["doc", "n", "a", "b", "sig"])


@lean
def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(band, no, v, n): the bucket of each band of a text's signature, the band's number, the text and its shingles."""
    for batch in batches:
        docs = np.asarray(batch.column("doc"))
        if len(docs) == 0:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(len(docs), -1).astype(U64)
        key = np.zeros((len(docs), bands), dtype=U64) + np.arange(bands, dtype=U64)
        for r in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows])
        columns = [key.ravel().view(np.int64), np.tile(np.arange(bands, dtype=np.int8), len(docs)), np.repeat(docs, bands), np.repeat(np.asarray(batch.column("n")), bands)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["band", "no", "v", "n"])


@lean
def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in the share ``least`` of the coordinates."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))


def _across(table: pa.Table, likely: float, threshold: float, bands: int, rows: int) -> pa.Table:
    """Links between different components found in one bucket, no more than tie these together.

    All likely pairs across components are verified on their whole multisets, in
    the first bucket that they share and until a link joins their components.
    """
    table = table.combine_chunks()
    v, c, part = (np.asarray(table[x]) for x in ("v", "c", "part"))
    i0, j0, no = (table[x][0].as_py() for x in ("i", "j", "no"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(v), -1)
    sets = [np.frombuffer(x, U64) for x in table["ids"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    names, of = np.unique(c, return_inverse=True)
    parent = np.arange(len(names))

    def roots(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while (up != parent[up]).any():
            up = parent[up]
        return up

    left, right = np.flatnonzero(part == i0), np.flatnonzero(part == j0)
    out: list[tuple[int, int]] = []
    for x in left:
        own = roots(of[x : x + 1])[0]
        y = right[(v[right] > v[x]) if i0 == j0 else np.ones(len(right), bool)]
        y = y[roots(of[y]) != own]
        same = sig[y] == sig[x]
        ok = same.mean(axis=1) >= likely
        y, same = y[ok], same[ok]
        if len(y) == 0:
            continue
        first = same[:, : bands * rows].reshape(len(y), bands, rows).all(axis=2).argmax(axis=1)
        y = y[first == no]
        if len(y) == 0:
            continue
        flat, ends = np.concatenate([sets[k] for k in y]), np.cumsum(sizes[y])
        hit = sets[x][np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)] == flat
        common = np.add.reduceat(hit, ends - sizes[y])
        for k in y[common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9]:
            a, b = roots(of[[x, k]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((min(v[x], v[k]), max(v[x], v[k])))
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


@lean
def _fetch(batches: Iterator[pa.RecordBatch], flags: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Sorted regions of the documents whose hashes are in the filter."""
    for batch in batches:
        picked = batch.filter(pa.array(may_hold(flags, np.asarray(batch.column("h")).view(U64))))
        docs, texts = np.asarray(picked.column("doc")), as_array(picked.column("text"))
        for lo, hi in slices(texts):
            words, firsts, _ = word_hashes(texts.slice(lo, hi - lo))
            shingles, starts = shingle_hashes(words, firsts, width)
            ids = regions(shingles, starts)
            yield pa.RecordBatch.from_arrays([pa.array(docs[lo:hi], pa.int64()), pa.array([np.sort(ids[a:b]).tobytes() for a, b in zip(starts, starts[1:])], pa.binary())], names=["v", "ids"])


@lean
def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            s, t = np.frombuffer(x, U64), np.frombuffer(y, U64)
            common = len(s) + len(t) - len(np.union1d(s, t))
            ok.append(common >= threshold * (len(s) + len(t) - common) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _sets(nodes: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """(v, ids): the sorted regions of the texts in ``nodes`` and, the filter being what it is, of a few others."""
    nodes = checkpointed(nodes.distinct())
    flags = narrow.sparkSession.sparkContext.broadcast(bloom(nodes.select(F.xxhash64("v").alias("h")), nodes.count()))
    hashed = narrow.withColumn("h", F.xxhash64("doc"))
    return hashed.mapInArrow(lambda it: _fetch(it, flags.value, width), "v long, ids binary").dropDuplicates(["v"])


def _links(pairs: DataFrame, narrow: DataFrame, threshold: float, width: int) -> DataFrame:
    """Those of the ``pairs`` whose weighted Jaccard similarity, exactly, reaches the threshold."""
    sets = checkpointed(_sets(pairs.select(F.explode(F.array("a", "b")).alias("v")), narrow, width))
    met = pairs.join(sets.select(F.col("v").alias("a"), F.col("ids").alias("x")), "a").join(sets.select(F.col("v").alias("b"), F.col("ids").alias("y")), "b")
    return checkpointed(met.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, threshold), "a long, b long"))


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5, bands: int = 25, rows: int = 5, likely: float = 0.6, key: str | None = None) -> DataFrame:
    """(doc, class_id, n_shingles): for each row of ``docs`` its key and the smallest key of its class.

    Two documents are linked if the weighted Jaccard similarity of their
    ``width``-word shingles (weight: number of occurrences) is at least
    ``threshold``; classes are the connected components of the links. Words are
    lower-cased runs of ASCII letters, digits and non-ASCII characters.

    Documents with equal word sequences are merged first. Signatures of
    ``bands * rows`` coordinates put texts into band buckets. In each bucket all
    are compared with its smallest member; then, in buckets that still touch
    several components, all pairs across components are, in pieces of bounded
    size, until a link joins them: the members of the largest component are dealt
    out once for each piece of all others together. What leaves a bucket are
    links, never pairs.
    Candidate pairs whose signatures agree in the share ``likely`` are verified
    on whole shingle multisets. At similarity 0.8 and the defaults a
    pair shares a bucket with probability 0.99995, and the estimate falls below
    ``likely`` with probability under 1e-6.

    The key is that of ``with_key``, or the column ``key``: doc_id, or a hash
    where that is null or names several texts. A text without words is alone in
    its class with 0 shingles; one of fewer than ``width`` words has one shingle,
    all of it; a very long text is one set, with memory of some 40 bytes a word;
    repeats of a row share a key and a class; ties between members go to the
    smallest key; an empty table gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    narrow = (docs.select(F.col(key).alias("doc"), "text") if key else with_key(docs.select("doc_id", "text"), "doc")).select("doc", "text")
    sketches = checkpointed(narrow.mapInArrow(lambda it: _sketches(it, width, bands * rows), "doc long, n long, a long, b long, sig binary"))
    merged = checkpointed(sketches.where("n > 0").groupBy("a", "b").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    banded = checkpointed(merged.select("doc", "n", "sig").mapInArrow(lambda it: _bands(it, bands, rows), "band long, no byte, v long, n long"))
    centres = banded.groupBy("band").agg(F.min("v").alias("m"), F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    signed = merged.select(F.col("doc").alias("v"), "sig")
    # Written down: joins of plain tables can be split where one text is in many pairs.
    stars = checkpointed(banded.join(centres, "band").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
    rated = stars.join(signed.select(F.col("v").alias("a"), F.col("sig").alias("sx")), "a").join(signed.select(F.col("v").alias("b"), F.col("sig").alias("sy")), "b")
    pairs = checkpointed(rated.select("a", "b", "sx", "sy").mapInArrow(lambda it: _likely(it, likely), "a long, b long"))
    links = _links(pairs, narrow, threshold, width)
    classes = checkpointed(components(links))
    # What a bucket's smallest member does not tie together: all pairs across components.
    labelled = banded.join(centres.select("band"), "band").join(classes, "v", "left").select("band", "no", "v", "n", F.coalesce("c", "v").alias("c"))
    parts = labelled.groupBy("band", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    whole = parts.groupBy("band").agg(F.max(F.struct("rows", "weight", "c")).alias("main"), F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.count("*").alias("k")).where("k > 1")
    pieces = lambda rows, weight: F.greatest(F.ceil(rows / GROUP_ROWS), F.ceil(weight * 8 / GROUP_BYTES)).cast("int")
    m = F.col("main")
    cut = whole.select("band", m["c"].alias("main"), pieces(F.col("rows") - m["rows"], F.col("weight") - m["weight"]).alias("few"), pieces(m["rows"], m["weight"]).alias("many"))
    members = checkpointed(labelled.drop("n").join(cut, "band"))
    if not members.isEmpty():
        # The largest component needs no pairs of its own: its pieces meet those of the others, which also meet each other.
        of = lambda n: F.pmod(F.xxhash64("v", F.lit(5)), n).cast("int")
        own = F.when(F.col("c") == F.col("main"), F.col("few") + of(F.col("many"))).otherwise(of(F.col("few")))
        meets = F.when(F.col("c") == F.col("main"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
        split = members.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), meets)))
        split = split.select("band", "no", "v", "c", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        sets = _sets(members.select("v"), narrow, width)
        crossed = split.join(signed, "v").join(sets, "v").groupBy("band", "i", "j").applyInArrow(lambda t: _across(t, likely, threshold, bands, rows), "a long, b long")
        more = checkpointed(crossed.distinct())
        if not more.isEmpty():
            # Between the components so far: a far smaller graph.
            at = lambda k: classes.select(F.col("v").alias(k), F.col("c").alias(f"c{k}"))
            between = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            joined = checkpointed(components(between))
            old = classes.join(joined.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
            classes = checkpointed(old.unionByName(joined).groupBy("v").agg(F.min("c").alias("c")))
    of_text = merged.select("a", "b", "doc").join(classes, merged["doc"] == classes["v"], "left").select("a", "b", F.coalesce("c", "doc").alias("class_id"))
    # A class is named by the smallest key among all its documents, which is that of a merged text.
    return sketches.join(of_text, ["a", "b"], "left").select("doc", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"), F.col("n").alias("n_shingles"))


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest key. Columns stay as they are.

    The classes are those of ``near_duplicate_classes``, which says what becomes
    of null, empty, short and very long texts, null ids and ids of several
    texts. Of exact repeats of a row one stays, and of repeats that differ in
    other columns any one; an empty table gives no rows; columns may have any
    names.
    """
    key, own, n = spare([*docs.columns, "doc"], "_key", "_own", "_n")
    rows = with_key(docs, key)
    classes = checkpointed(near_duplicate_classes(rows, key=key, **settings))
    kept = classes.where("doc = class_id").groupBy(F.col("doc").alias(own)).agg(F.count("*").alias(n))
    out = rows.join(kept, F.col(key) == F.col(own))
    if kept.where(F.col(n) > 1).isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.where(F.col(n) == 1).unionByName(out.where(F.col(n) > 1).dropDuplicates([key])).select(*[F.col(f"`{c}`") for c in docs.columns])
