"""Near duplicates against all pairs; signatures against their similarity; components against union-find."""

import random
from collections import Counter

import numpy as np

from wattline.llm import neardup
from wattline.llm.graph import components
from wattline.llm.neardup import dart_minhash, keep_one_of_each, near_duplicate_classes


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((40, 20), (300, 240), (3000, 2700)):
        ids = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        both = np.concatenate((ids[:n], ids[n - common :]))
        sig = dart_minhash(both, np.array([0, n, 2 * n]), 2000)
        assert abs((sig[0] == sig[1]).mean() - common / (2 * n - common)) < 0.05
    assert dart_minhash(np.zeros(0, np.uint64), np.array([0, 0]), 4).shape == (1, 4)


def shingles(text):
    words = text.lower().split()
    return Counter(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def brute(rows):
    sets = {i: shingles(t or "") for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 5, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 6, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((at, " ".join(text)))
            at += 3
    return rows + [(1000, None), (1001, ""), (1002, ""), (1003, "... !!"), (1004, "a " * 500), (1005, "a " * 510)]


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP_ROWS", 3)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, n int").repartition(3)
    out = {r["doc"]: r["class_id"] for r in near_duplicate_classes(docs).collect()}
    assert out == brute(rows)
    kept = sorted(r["doc_id"] for r in keep_one_of_each(docs).collect())
    assert kept == sorted(set(brute(rows).values()))


def test_repeats_and_null_ids(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (9, "A, b c d e f!"), (None, "q r s t u"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in keep_one_of_each(docs).collect() if r["doc_id"]) == [(5, "a b c d e f")]
    assert keep_one_of_each(docs).count() == 2
    assert near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)]
    parent = {v: v for link in links for v in link}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {v: root(v) for v in parent if any(v in x and x[0] != x[1] for x in links)}
    assert {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_weighted_signatures_estimate_weighted_similarity():
    """Whole and fractional weights, each element once; an element's areas do not grow with its weight."""
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 2**63, 60).astype(np.uint64)
    for scale in (1.0, 0.37, 40.0):
        a, b = scale * rng.integers(1, 9, 60), scale * rng.integers(1, 9, 60)
        sig = dart_minhash(np.concatenate((ids, ids)), np.array([0, 60, 120]), 4000, np.concatenate((a, b)))
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_a_large_group_of_near_copies_and_clashing_names(spark, monkeypatch):
    """Most of a bucket in one component, the rest in others; columns called like the operator's own."""
    monkeypatch.setattr(neardup, "GROUP_ROWS", 16)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            text[rng.randrange(60)] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(text), "a", 1, 2, 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, count int, doc int, _key int").repartition(3)
    want = brute([(i, t) for i, t, *_ in rows])
    assert {r["doc"]: r["class_id"] for r in near_duplicate_classes(docs).collect()} == want
    assert sorted(map(tuple, keep_one_of_each(docs).collect())) == sorted(r for r in rows if want[r[0]] == r[0])


def test_a_very_long_text(spark):
    text = " ".join(f"w{k % 5000}" for k in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other " * 300_000)], "doc_id long, text string")
    out = {r["doc"]: (r["class_id"], r["n_shingles"]) for r in near_duplicate_classes(docs).collect()}
    assert out == {1: (1, 399_996), 2: (1, 399_997), 3: (3, 299_996)}


def test_texts_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "f g h i j"), (1, "f g h i j"), (2, "F g h i j")], "doc_id long, text string")
    assert sorted(r["text"].lower() for r in keep_one_of_each(docs).collect()) == ["a b c d e", "f g h i j"]
