"""Texts of more than a megabyte: the same results as from plain computations on whole texts."""

import random

import numpy as np
import pyarrow as pa

from wattline.llm.langid import identify_language, ngram_buckets
from wattline.llm.packing import Encoder, default_tokenizer
from wattline.llm.substring import cut_points, dedup_substrings
from wattline.llm.textkit import buffers, parts


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "whole", "über", "naïve", "thing", "x7", "été.")) + rng.choice("abc") for _ in range(n))


def test_ngrams_of_parts_are_those_of_the_whole():
    text = words(300_000, 1)
    for order in (2, 3):
        ((whole, own),) = ngram_buckets(pa.array([text]), (order,), 15)
        together = np.zeros(1 << 15, np.int64)
        pieces = list(parts(pa.array([text]), b" .0123456789"))
        for _, _, part in pieces:
            ((bucket, _),) = ngram_buckets(part, (order,), 15)
            together += np.bincount(bucket[bucket >= 0], minlength=1 << 15)
        assert len(pieces) > 1 and (together == np.bincount(whole[whole >= 0], minlength=1 << 15)).all()


def test_language_of_a_long_text(spark):
    rows = [(i, words(20, i), "en") for i in range(40)] + [(i, "zzz qqq " * 5, "qq") for i in range(40, 80)] + [(99, words(200_000, 3), None), (100, "q" * 2_000_000, None)]
    found = {r["doc_id"]: r["lang_pred"] for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[99] == "en" and found[100] == "qq"


def test_ids_of_a_long_text():
    encoder = Encoder(default_tokenizer())
    for text in (words(250_000, 5), "x" * 1_200_000 + " the end", "\n".join(["one line"] * 150_000)):
        assert encoder.ids(text) == encoder._encoded(text)


def test_chunks_of_a_long_text():
    text = words(120_000, 7)
    data, offsets = buffers(pa.array(["short", text, "", text[:5000]]))
    starts, ends = cut_points(data, offsets, 4, 512)
    for i in (1, 3):
        own = data[offsets[i] : offsets[i + 1]]
        s, e = cut_points(own, np.array([0, len(own)]), 4, 512)
        mine = (starts >= offsets[i]) & (ends <= offsets[i + 1]) & (starts < ends)
        assert np.array_equal(starts[mine] - offsets[i], s) and np.array_equal(ends[mine] - offsets[i], e)


def test_a_long_repeated_passage(spark):
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, "before " + passage), (2, passage + " after")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in dedup_substrings(docs).collect()}
    assert out[1]["text"] == "before " + passage and len(out[2]["text"]) < 300 and out[2]["text"].endswith("after")
