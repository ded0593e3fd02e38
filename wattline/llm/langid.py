"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wattline.llm.runtime import held_out, lean, session_of, ship, spare, unit_hash
from wattline.llm.textkit import as_array, buffers, parts

UNDETERMINED = "und"
#: More values of lang than there are languages; beyond them, further ones are not learned.
MOST_LANGS = 8192
#: Floats in the model: with more than 1,024 languages there are fewer buckets for each.
MODEL_BITS = 25
#: ASCII characters that are no letters: n-grams never reach over them, so a text can be cut there.
NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: is it a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with every run of non-letters as one blank (0), and where each text starts.

    A blank stands before and after each text, so n-grams never span texts.
    """
    import pyarrow.compute as pc

    data, offsets = buffers(pc.utf8_lower(pc.fill_null(column, "")))
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(heads) - 1
    out = np.zeros(len(code) + n + 1, dtype=np.uint32)
    text = np.repeat(np.arange(n), np.diff(heads))
    out[np.arange(len(code)) + text + 1] = np.where(_letters()[code], code, 0)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    keep[heads + np.arange(n + 1)] = True  # the blank before each text
    return out[keep], np.concatenate(([0], np.cumsum(keep)))[heads + np.arange(n + 1)]


def ngram_buckets(column: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at each place (-1: blanks only), and where each text's places start."""
    codes, firsts = _codes(column)
    for n in orders:
        size = len(codes) - n + 1
        if size <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(firsts), np.int64)
            continue
        h = np.full(size, n, dtype=np.uint32)
        inner = np.zeros(size, dtype=bool)
        for k in range(n):
            part = codes[k : k + size]
            h = (h ^ part) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                inner |= part == 0
        bucket = (h >> np.uint32(32 - bits)).astype(np.int64)
        blank = inner | ((codes[:size] == 0) & (codes[n - 1 : n - 1 + size] == 0))
        bucket[blank] = -1
        yield bucket, np.minimum(firsts, size)


@lean
def _count(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...], bits: int) -> Iterator[pa.RecordBatch]:
    """Per language of this partition a vector of n-gram counts."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.asarray(batch.column("lang").to_pylist(), dtype=object), as_array(batch.column("text"))
        for a, b, part in parts(texts, NO_LETTERS):
            for bucket, firsts in ngram_buckets(part, orders, bits):
                for lang in set(langs[a:b]):
                    mask = np.repeat(langs[a:b] == lang, np.diff(firsts))
                    own = bucket[firsts[0] : firsts[-1]][mask]
                    counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                    counts[lang] += np.bincount(own[own >= 0], minlength=1 << bits)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["lang", "counts"])


def train(labelled: DataFrame, max_rows: int = 20_000, orders: tuple[int, ...] = (2, 3), bits: int = 15, smoothing: float = 0.5, most_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the matrix of log probabilities (buckets x languages).

    With very many languages there are fewer than ``2**bits`` buckets (``MODEL_BITS``). ``labelled`` has columns doc_id, lang (not null) and text. The ``most_langs``
    commonest values of lang, ties in alphabetical order, are learned. About
    ``max_rows`` rows (the same number of each language where there are enough)
    are fitted on, chosen by a hash of id and text, repeats of a row once; the
    priors count all rows of the learned languages.
    """
    spark = session_of(labelled)
    ship(spark)
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(totals)
    if not langs:
        return [], np.zeros(0), np.zeros((1 << bits, 0), np.float32)
    share = max_rows / len(langs)
    bits = min(bits, MODEL_BITS - (len(langs) - 1).bit_length())
    rates = spark.createDataFrame([(k, share / v) for k, v in totals.items()], "lang string, rate double")  # ``most_langs`` rows
    drawn = labelled.join(F.broadcast(rates), "lang").where(unit_hash("doc_id", "text", salt=4) < F.col("rate")).select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang", "text"]).select("lang", "text")
    counts = {x: np.zeros(1 << bits, np.int64) for x in langs}
    for r in drawn.mapInArrow(lambda it: _count(it, orders, bits), "lang string, counts binary").toLocalIterator():
        counts[r["lang"]] += np.frombuffer(r["counts"], np.int64)
    table = np.stack([np.log((counts[x] + smoothing) / (counts[x].sum() + smoothing * (1 << bits))) for x in langs], axis=1)
    prior = np.log(np.array([totals[x] for x in langs], float) / sum(totals.values()))
    return langs, prior, table.astype(np.float32)


def _score(texts: pa.Array, langs: list[str], prior: np.ndarray, table: np.ndarray, orders: tuple[int, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and its posterior for every text, and whether it has a letter."""
    n, width, bits = len(texts), len(langs), len(table).bit_length() - 1
    total, seen = np.zeros((n, width)), np.zeros(n, np.int64)
    for a, b, part in parts(texts, NO_LETTERS):
        for bucket, firsts in ngram_buckets(part, orders, bits):
            ok = bucket >= 0
            ends = np.concatenate(([0], np.cumsum(ok)))[firsts]
            picked = bucket[ok]
            seen[a:b] += np.diff(ends)
            for k in range(width):
                run = np.zeros(len(picked) + 1)
                np.cumsum(table[:, k][picked], out=run[1:])
                total[a:b, k] += run[ends[1:]] - run[ends[:-1]]
    if not width:
        return [UNDETERMINED] * n, np.zeros(n), seen > 0
    logit = total + prior
    logit -= logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [langs[k] if s else UNDETERMINED for k, s in zip(best, seen)], np.where(seen > 0, p[np.arange(n), best], 0.0), seen > 0


def with_language(docs: DataFrame, max_rows: int = 20_000, orders: tuple[int, ...] = (2, 3), bits: int = 15, most_langs: int = MOST_LANGS) -> DataFrame:
    """``docs`` with the columns lang_pred, score and has_letters, in place of any of these names.

    Learns from text and non-null lang of documents that are not held out (the
    quarter whose crc32 of the id as text leaves 2 on division by 4); a
    prediction looks at nothing but the text, and no other column leaves the JVM.
    ``score`` is the posterior of the predicted language. The broadcast model
    holds ``2**bits`` floats for each language, ``2**MODEL_BITS`` at the most.

    A null text, a text without letters, and any text when nothing could be
    learned give ``und`` with score 0; ties go to the first language in
    alphabetical order; a very long text is read in parts of about 1 MB, cut
    where there is no letter, which changes nothing but the order of a sum;
    repeated rows are scored alike; a null id counts as not held out; an empty
    table gives no rows; other columns pass through.
    """
    spark = session_of(docs)
    ship(spark)
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    langs, prior, table = train(labelled, max_rows, orders, bits, most_langs=most_langs)
    model = spark.sparkContext.broadcast((langs, prior, table))

    @arrow_udf("struct<lang_pred: string, score: double, has_letters: boolean>")
    @lean
    def told(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            pred, score, letters = _score(as_array(texts), *model.value, orders)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(letters)], names=["lang_pred", "score", "has_letters"])

    docs = docs.drop("lang_pred", "score", "has_letters")
    (own,) = spare(docs.columns, "_told")
    return docs.withColumn(own, told("text")).select(*[F.col(f"`{c}`") for c in docs.columns], f"{own}.*")


def identify_language(docs: DataFrame, **settings) -> DataFrame:
    """Predicted language of every whole text, as ``with_language`` has it: doc_id, held_out, lang_pred, score."""
    return with_language(docs, **settings).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
