"""Toxicity by noisy-channel deobfuscation: Viterbi decoding under a character model, then scoring the restored text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.runtime import block, checkpointed, held_out, lean, ship, sum_blocks, unit_hash
from wattline.llm.textkit import as_array, buffers, mix, parts, slices, span_hash, word_spans

U64 = np.uint64

# What a leetspeak character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i",
}
BETWEEN = " .-_*\t"
INSIDE = "-_*"
# Costs of the channel, in nats.
SUBSTITUTED, LITERAL, DROPPED, BROKEN, SQUEEZED, JOINED = 1.0, 6.0, 0.5, 2.0, 1.0, 2.0

_GAP, _ONE = r"[ \t.\-_*]{1,3}", r"(?:[^\W_]|[@$!|+€£¡])"
# Characters set apart one by one; leetspeak before letters; leetspeak that ends a word; words tied by separators; all
# letters of a word doubled; a letter three times in a row.
_PIECES = re.compile(
    rf"(?<![^\W_]){_ONE}(?:{_GAP}{_ONE}(?![^\W_])){{2,}}"
    r"|[^\W_]*(?:[0-9@$!|+€£¡]+[^\W\d_]+)+[0-9@$!|+€£¡]*"
    r"|(?<![^\W\d_])[^\W\d_]++[0-9@$!|+€£¡]+"
    r"|(?<![^\W\d_])[^\W\d_]++(?:[\-_*][^\W\d_]++)+"
    r"|(?<![^\W\d_])(?:([^\W\d_])\1+){3,}(?![^\W\d_])"
    r"|[^\W\d_]*?([^\W\d_])\2\2[^\W\d_]*"
)
_SPACED = re.compile(rf"{_ONE}(?:{_GAP}{_ONE}){{2,}}")
_DOUBLED = re.compile(r"(?:([^\W\d_])\1+){3,}")
_LETTER, _WORDLIKE, _LEET, _BETWEEN, _INSIDE = 1, 2, 4, 8, 16
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Per code point, what the pattern takes it for: a letter, a letter or digit, leetspeak, a separator."""
    if not _KINDS:
        kind = np.fromiter(((_WORDLIKE | (0 if c.isdecimal() else _LETTER)) if (c := chr(i)).isalnum() else 0 for i in range(0x110000)), dtype=np.uint8, count=0x110000)
        kind[[ord(c) for c in LEET]] |= _LEET
        kind[[ord(c) for c in BETWEEN]] |= _BETWEEN
        kind[[ord(c) for c in INSIDE]] |= _INSIDE
        _KINDS.append(kind)
    return _KINDS[0]


CLASSES = 64
OTHER = 63


def char_class(c: str) -> int:
    """0: no letter; 1 to 26: a to z; then the lower-case letters U+00DF to U+00FF; the rest are one class."""
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xDF <= o <= 0xFF and o != 0xF7:
        return 27 + o - 0xDF
    return OTHER if c.isalpha() else 0


_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASS:
        _CLASS.append(np.fromiter((char_class(chr(c)) for c in range(0x110000)), dtype=np.uint8, count=0x110000))
    return _CLASS[0]


@lean
def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character trigrams within and at the edges of words, in a block for each first character."""
    counts = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for _, _, part in parts(as_array(batch.column("text"))):
            joined = "  ".join(x or "" for x in pc.utf8_lower(part).to_pylist())
            code = _classes()[np.frombuffer(f"  {joined}  ".encode("utf-32-le"), np.uint32)].astype(np.int32)
            code = code[np.concatenate(([True, True], (code[2:] != 0) | (code[1:-1] != 0) | (code[:-2] != 0)))]
            counts += np.bincount((code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:], minlength=CLASSES**3)
    chunks = counts.reshape(CLASSES, -1)
    used = [i for i in range(CLASSES) if chunks[i].any()]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block(chunks[i]) for i in used], pa.binary())], names=["chunk", "counts"])


def language_model(texts: DataFrame) -> np.ndarray:
    """Log probabilities [before last, last, next] of character classes, from all texts; interpolated with lower orders."""
    counts = np.zeros((CLASSES, CLASSES, CLASSES))
    for chunk, total in sum_blocks(texts.select("text").mapInArrow(_count_trigrams, "chunk int, counts binary")):
        counts[chunk] = total.reshape(CLASSES, CLASSES)
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (counts + 10 * two[None]) / (counts.sum(axis=2, keepdims=True) + 10)
    return np.log(three)


class Restorer:
    """Decodes obfuscated pieces of lower-case text, remembering a bounded number of them."""

    def __init__(self, model: np.ndarray, most: int = 50_000):
        self.model, self.most, self.known = model.tolist(), most, {}

    def lattice(self, piece: str) -> list[list[tuple[str, float]]]:
        """For each stretch of the piece, what it may stand for and at what cost.

        Leetspeak stands for letters or itself, separators between single
        letters for nothing or a break, ones between words for themselves or
        nothing, a letter three or more times in a row, or each twice or more in
        a word of such letters, for one or two; any other character for itself
        alone. Exclamation marks that end a piece are themselves at no cost.
        """
        spaced = _SPACED.fullmatch(piece) is not None
        least = 2 if not spaced and _DOUBLED.fullmatch(piece) else 3
        marks = len(piece.rstrip("!"))
        out, i = [], 0
        while i < len(piece):
            c, run = piece[i], 1
            while i + run < len(piece) and piece[i + run] == c:
                run += 1
            if spaced and c in BETWEEN:
                out.append([("", DROPPED), (" ", BROKEN)])
                i += 1
                while piece[i] in BETWEEN:
                    i += 1
            elif not spaced and c in INSIDE:
                out.append([(c, 0.0), ("", JOINED)])
                i += 1
            elif c in LEET:
                options, literal = [(x, SUBSTITUTED) for x in LEET[c]], 0.0 if 0 < marks <= i and not spaced else LITERAL
                if run > 2:
                    out.append(options + [(c * run, literal)])
                    i += run
                else:
                    out.append(options + [(c, literal)])
                    i += 1
            elif run >= least and c.isalpha():
                out.append([(c, SQUEEZED), (c * 2, SQUEEZED)])
                i += run
            else:
                out.append([(c, 0.0)])
                i += 1
        return out

    def decode(self, piece: str) -> str:
        """The likeliest reading under channel and character model together (Viterbi over pairs of last characters)."""
        if (found := self.known.get(piece)) is not None:
            return found
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(piece):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in states.items():
                for emitted, cost in options:
                    x, y, s = a, b, score - cost
                    for c in emitted:
                        z = char_class(c)
                        if not (z == 0 and y == 0):
                            s += self.model[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < s:
                        after[x, y] = (s, text + emitted)
            states = after
        best = max((score + self.model[a][b][0] if b else score, text) for (a, b), (score, text) in states.items())[1]
        if len(piece) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[piece] = best
        return best

    def restore(self, text: str) -> str:
        """The lower-case text with every obfuscated piece decoded."""
        return _PIECES.sub(lambda m: self.decode(m[0]), text)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that hold every match of the pattern.

    A run is a longest row of letters, digits and leetspeak. Matches without
    separators lie within a run that has leetspeak next to a letter, a letter
    three times in a row or two doubled ones. Matches of single characters go
    from the last character of a run over runs of one character, one to three
    separators before each, to the first character of a run; inside longer runs
    symbols alone may stand next to them. Tied words are runs with a separator
    between a letter and a letter. Stretches are whole runs, so they match by
    themselves as within the text.
    """
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _kinds()[code]
    edge = np.zeros(len(code) + 1, dtype=bool)
    edge[np.searchsorted(at, offsets)] = True
    core, letter, word, leet = (kind & (_WORDLIKE | _LEET)) > 0, (kind & _LETTER) > 0, (kind & _WORDLIKE) > 0, (kind & _LEET) > 0
    joined = core[1:] & core[:-1] & ~edge[1:-1]
    s, e = np.flatnonzero(core & ~np.concatenate(([False], joined))), np.flatnonzero(core & ~np.concatenate((joined, [False]))) + 1
    if len(s) == 0:
        return s, e
    hit = np.zeros(len(code), dtype=bool)
    hit[:-1] = joined & ((leet[:-1] & letter[1:]) | (letter[:-1] & leet[1:]))
    hit[:-2] |= joined[:-1] & joined[1:] & letter[:-2] & (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:])
    pair = np.zeros(len(code) + 2, dtype=bool)
    pair[: len(code) - 1] = joined & letter[1:] & (code[1:] == code[:-1])
    hit |= pair[: len(code)] & pair[2:]
    hits = np.concatenate(([0], np.cumsum(hit)))
    found = hits[e] > hits[s]
    # One to three separators between neighbouring runs, all of one text.
    one = e - s == 1
    gap = s[1:] - e[:-1]
    between, edges = np.concatenate(([0], np.cumsum((kind & _BETWEEN) > 0))), np.concatenate(([0], np.cumsum(edge)))
    link = np.zeros(len(s) + 1, dtype=bool)
    link[1:-1] = (gap <= 3) & (between[s[1:]] - between[e[:-1]] == gap) & (edges[s[1:] + 1] == edges[e[:-1]])
    tied = np.zeros(len(s) + 1, dtype=bool)
    tied[1:-1] = link[1:-1] & (gap == 1) & ((kind[e[:-1]] & _INSIDE) > 0) & letter[e[:-1] - 1] & letter[s[1:]]
    knot_first, knot_last = np.flatnonzero(tied[1:] & ~tied[:-1]), np.flatnonzero(tied[:-1] & ~tied[1:])
    head, tail = one | ~word[np.maximum(e - 2, 0)], one | ~word[np.minimum(s + 1, len(word) - 1)]
    chained = link[1:-1] & one[1:] & one[:-1]
    first, last = np.flatnonzero(one & ~np.concatenate(([False], chained))), np.flatnonzero(one & ~np.concatenate((chained, [False])))
    first, last = first - (link[first] & head[first - 1]), last + (link[last + 1] & tail[(last + 1) % len(s)])
    long = last - first >= 2
    starts, ends = np.concatenate((s[found], s[first[long]], s[knot_first])), np.concatenate((e[found], e[last[long]], e[knot_last]))
    where = np.append(at, len(data))
    return where[starts], where[ends]


def restored(texts: pa.Array, restorer: Restorer) -> pa.Array:
    """Lower-case texts with obfuscations undone; only suspicious stretches are decoded, very long texts in parts."""
    out: list = [""] * len(texts)
    whole = list(parts(texts, b"\n"))
    if len(whole) == 1:
        return _restored(texts, restorer)
    for a, b, part in whole:
        for i, text in zip(range(a, b), _restored(part, restorer).to_pylist()):
            out[i] = out[i] + text if out[i] else text
    return pa.array(out, texts.type)


def _restored(texts: pa.Array, restorer: Restorer) -> pa.Array:
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    data, offsets = buffers(low)
    starts, ends = _pieces(data, offsets)
    if len(starts) == 0:
        return low
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], ends[order]
    top = np.maximum.accumulate(ends)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] >= top[:-1]
    starts, ends = starts[new], np.maximum.reduceat(ends, np.flatnonzero(new))
    text = np.searchsorted(offsets, starts, side="right") - 1
    raw, values = data.tobytes(), low.to_pylist()
    for i in np.unique(text):
        out, last = [], int(offsets[i])
        for a, b in zip(starts[text == i].tolist(), ends[text == i].tolist()):
            out += [raw[last:a], restorer.restore(raw[a:b].decode()).encode()]
            last = b
        values[i] = b"".join([*out, raw[last : offsets[i + 1]]]).decode()
    return pa.array(values, low.type)


FEATURE_BITS = 19


def _features(low: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word and of its first 4 and 5 bytes (words x 3), the word's own hash, and where each text's words start."""
    data, offsets = buffers(low)
    starts, ends = word_spans(data, offsets)
    whole = span_hash(data, starts, ends)
    kinds = [whole, *(mix(span_hash(data, starts, np.minimum(ends, starts + k)) + U64(k)) for k in (4, 5))]
    return np.stack([(h >> U64(64 - FEATURE_BITS)).astype(np.int64) for h in kinds], axis=1), whole, np.searchsorted(starts, offsets)


def _restored_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[tuple[pa.RecordBatch, int, int, pa.Array]]:
    restorer = Restorer(model.value)
    for batch in batches:
        texts = as_array(batch.column("text"))
        for a, b in slices(texts):
            yield batch, a, b, restored(texts.slice(a, b - a), restorer)


@lean
def _count_features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Texts and toxic texts that have each feature, of this partition."""
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch, a, b, low in _restored_batches(batches, model):
        toxic = np.asarray(batch.column("toxic"))[a:b]
        rows += len(toxic), int(toxic.sum())
        buckets, _, firsts = _features(low)
        for i in range(b - a):
            own = np.unique(buckets[firsts[i] : firsts[i + 1]])
            counts[0, own] += 1
            if toxic[i]:
                counts[1, own] += 1
    yield pa.RecordBatch.from_arrays([pa.array([rows[0]]), pa.array([rows[1]]), pa.array([counts.tobytes()], pa.binary())], names=["n", "toxic", "counts"])


def evidence(low: pa.Array, weight: np.ndarray) -> np.ndarray:
    """Per text: strongest word, sum over its distinct telling words, their number, and their share of the words (log)."""
    buckets, whole, firsts = _features(low)
    n = len(low)
    out = np.zeros((n, 4))
    best = weight[buckets].max(axis=1) if len(buckets) else np.zeros(0)
    at = np.flatnonzero(best > 0)
    text = np.searchsorted(firsts, at, side="right") - 1
    for i in np.unique(text):
        mine = at[text == i]
        _, pick = np.unique(whole[mine], return_index=True)
        w = np.sort(best[mine][pick])[::-1]
        out[i] = w[0], w[:5].sum(), min(len(w), 5), np.log((1 + len(mine)) / (1 + firsts[i + 1] - firsts[i]))
    return out


@lean
def _evidence_rows(batches: Iterator[pa.RecordBatch], model, weight) -> Iterator[pa.RecordBatch]:
    for batch, a, b, low in _restored_batches(batches, model):
        x = evidence(low, weight.value)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)] + [batch.column("toxic").slice(a, b - a)], names=["x0", "x1", "x2", "x3", "toxic"])


def _design(x: np.ndarray) -> np.ndarray:
    hit = (x[:, 2] > 0).astype(float)
    return np.column_stack([np.ones(len(x)), hit, x[:, 0], x[:, 1], x[:, 2], x[:, 3] * hit])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method for ridge-regularised logistic regression; the first column is not regularised."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.3, least_texts: int = 4, least_z: float = 5.0, carry_text: bool = False) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score, predicted (and, if asked, restored_text).

    A trigram character model is counted over all texts. In each text the pieces
    that look obfuscated (leetspeak in words or at their ends, letters set apart one by one
    by up to three separators, words tied by separators, letters doubled throughout or three
    or more times in a row) become lattices of readings, decoded
    by Viterbi under channel costs and model. Words of the restored texts, and
    their first four and five bytes, that are significantly commoner in toxic
    than in other labelled texts carry log-odds; a logistic model turns a text's
    strongest such words into the score. Labels are read for rows that are not
    held out only, about ``max_rows`` of them, chosen by a hash of the id; the
    score looks at nothing but the text.

    A null or empty text is scored by the intercept; without labels every score
    is 0, with labels of one kind it is that kind's share; labels that are null
    are ignored, and of several labels of one id the largest counts; a null id
    counts as not held out and has no label; a very long text is restored in
    parts of about 1 MB; repeated rows are scored alike and learned from once; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(language_model(narrow))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    drawn = usable.where(unit_hash("doc_id", salt=1) * max(n, 1) < max_rows)
    weight, w = np.zeros(1 << FEATURE_BITS, np.float32), np.array([-30.0, 0, 0, 0, 0, 0])
    if n:
        sample = checkpointed(narrow.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "toxic"))
        counts, rows = np.zeros((2, 1 << FEATURE_BITS)), np.zeros(2)
        for r in sample.mapInArrow(lambda it: _count_features(it, model), "n long, toxic long, counts binary").toLocalIterator():
            counts += np.frombuffer(r["counts"], np.int32).reshape(2, -1)
            rows += r["n"], r["toxic"]
        base = (rows[1] + 0.5) / (rows[0] + 1)
        expected = counts[0] * base
        z = (counts[1] - expected) / np.sqrt(np.maximum(expected * (1 - base), 1e-9))
        telling = (counts[1] >= least_texts) & (z >= least_z)
        odds = np.log((counts[1] + 0.5) / (counts[0] - counts[1] + 0.5)) - np.log(base / (1 - base))
        weight = np.where(telling, np.maximum(odds, 0), 0).astype(np.float32)
        if 0 < rows[1] < rows[0]:
            held = spark.sparkContext.broadcast(weight)
            seen = sample.mapInArrow(lambda it: _evidence_rows(it, model, held), "x0 double, x1 double, x2 double, x3 double, toxic int").toPandas().to_numpy(dtype=float)
            w = fit_logistic(_design(seen[:, :4]), seen[:, 4])
        else:
            w[0] = np.log(base / (1 - base)) if rows[0] else -30.0
    final = spark.sparkContext.broadcast((weight, w))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, w = final.value
        for batch, a, b, low in _restored_batches(batches, model):
            score = 1 / (1 + np.exp(-np.clip(_design(evidence(low, weight)) @ w, -60, 60)))
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(score)] + ([low.cast(pa.string())] if carry_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score"] + ["restored_text"] * carry_text)

    out = narrow.mapInArrow(run, "doc_id long, score double" + ", restored_text string" * carry_text)
    extra = ["restored_text"] * carry_text
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *extra)
