"""Language ID: held-out accuracy and defined results for odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa

from wattline.llm.langid import identify_language, ngram_buckets, train, with_language
from wattline.llm.runtime import unit_hash

STEMS = {"en": ["the", "thing", "whole", "with", "ing", "tion"], "de": ["der", "schein", "keit", "über", "ung", "nicht"], "fr": ["le", "eau", "être", "çon", "que", "oui"], "es": ["el", "ción", "ñada", "llar", "mente", "ado"]}


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) for _ in range(30)).title(), lang, "x") for i in range(400) for lang in [rng.choice(sorted(STEMS))]]
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 34 !!", "en", "x"), (None, "the whole thing", None, "x"), (3, rows[3][1], rows[3][2], "x"), (903, "über " * 20_000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = identify_language(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert [by[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and by[900]["score"] == 0
    assert by[None]["lang_pred"] == "en" and by[903]["lang_pred"] == "de" and not by[None]["held_out"]
    held = [(r, rows[r["doc_id"]][2]) for r in out if r["held_out"] and r["doc_id"] < 400]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r, _ in held)
    assert np.mean([r["lang_pred"] == lang for r, lang in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in out)
    carried = with_language(docs)
    assert carried.columns == ["doc_id", "text", "lang", "lang_pred", "score", "has_letters"] and carried.count() == len(rows)


def test_nothing_to_learn_from_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in identify_language(docs).collect()] == [("und", 0.0)]
    assert identify_language(docs.limit(0)).count() == 0


def test_ngrams_do_not_depend_on_the_batch():
    texts = ["ab cd", "", None, "é!!x", "zz"]
    for order in (1, 2, 3):
        ((together, firsts),) = ngram_buckets(pa.array(texts), (order,), 15)
        for i, t in enumerate(texts):
            ((alone, own),) = ngram_buckets(pa.array([t], pa.string()), (order,), 15)
            assert sorted(x for x in together[firsts[i] : firsts[i + 1]] if x >= 0) == sorted(x for x in alone[own[0] : own[1]] if x >= 0)


def test_against_a_plain_naive_bayes(spark):
    """Every posterior against counts in dictionaries, all labelled rows being in the sample."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(STEMS[x]) + rng.choice(["", "a", "é", " 7 "]) for _ in range(rng.choice([1, 3, 12]))), x) for i in range(120) for x in [rng.choice(sorted(STEMS))]]
    rows += [(500, None, "en"), (501, "...", "de")]
    learn = [(t, x) for i, t, x in rows if t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    bits = 12

    def grams(text):
        found = []
        for order in (2, 3):
            ((bucket, own),) = ngram_buckets(pa.array([text]), (order,), bits)
            found += [int(x) for x in bucket[own[0] : own[1]] if x >= 0]
        return found

    langs = sorted({x for _, x in learn})
    counts = {x: np.zeros(1 << bits) for x in langs}
    for t, x in learn:
        for g in grams(t):
            counts[x][g] += 1
    want = {}
    for i, t, _ in rows:
        own = grams(t) if t else []
        logs = np.array([np.log(sum(y == x for _, y in learn) / len(learn)) + sum(np.log((counts[x][g] + 0.5) / (counts[x].sum() + 0.5 * (1 << bits))) for g in own) for x in langs])
        p = np.exp(logs - logs.max())
        want[i] = (langs[int(p.argmax())], float((p / p.sum()).max())) if own else ("und", 0.0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for r in identify_language(docs, bits=bits, max_rows=10**9).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-4, r


def test_the_sample_is_bounded_and_knows_no_hot_text(spark):
    """A text that most rows have is drawn by its ids like any other; repeats of a row are learned from once."""
    rows = [(i, "hot text here", "en") for i in range(6000)] + [(i, f"other w{i}", "en") for i in range(6000, 10_000)] + [(3, "hot text here", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = docs.where(unit_hash("doc_id", "text", salt=4) < 1000 / len(rows)).dropDuplicates(["doc_id", "lang", "text"])
    assert 800 < drawn.count() < 1200 and 400 < drawn.where("text = 'hot text here'").count() < 700


def test_commonest_languages_are_learned(spark):
    rows = [(i, f"text {i}", f"l{min(i, 900 - i) % 40}") for i in range(900)]
    langs, prior, table = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_langs=5)
    assert len(langs) == 5 == table.shape[1] and abs(np.exp(prior).sum() - 1) < 1e-9


def test_many_languages(spark):
    """All of 600 values are learned, with fewer buckets for each where the model would grow beyond its bound."""
    from wattline.llm import langid

    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(2 * k + j, f"{letters[k % 26]}{letters[k // 26]}{letters[(7 * k) % 26]} " * 9, f"l{k:04d}") for k in range(600) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prior, table = langid.train(docs)
    assert len(langs) == len(prior) == 600 and table.shape == (1 << 15, 600) and table.size <= 1 << langid.MODEL_BITS
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify_language(docs).collect()}
    known = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    right = [out[i] == lang for i, _, lang in rows if lang in known]
    assert np.mean(right) > 0.95 and len(set(out.values())) > 500
