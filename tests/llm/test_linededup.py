"""Line dedup against all pairs."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import Row

from wattline.llm.linededup import remove_repeated_lines


def brute(rows, share=Fraction(4, 5)):
    """Texts after removing every line with an earlier line of Jaccard ``share`` or more; rows are (id, text), ids unique."""
    lines = sorted((i, k, line) for i, text in rows if text is not None for k, line in enumerate(text.split("\n")))
    sets = [(i, k, frozenset(re.findall(r"[a-z0-9\x80-\U0010ffff]+", line.lower()))) for i, k, line in lines]
    gone = {}
    for at, (i, k, s) in enumerate(sets):
        if s and any(len(s & t) >= share * len(s | t) for _, _, t in sets[:at] if t):
            gone.setdefault(i, set()).add(k)
    return {i: (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(i, ())), sorted(gone.get(i, ()))) for i, text in rows}


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["été", "ñu"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 20, 45]))] for _ in range(40)]

    def line():
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            at = rng.randrange(len(words))
            words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
        return " ".join(words).capitalize() + rng.choice(["", ".", "!"])

    rows = [(i, "\n".join(line() for _ in range(rng.choice([0, 1, 3, 8])))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "\n\n...\n***"), (503, "x " * 3000), (504, "x")]


def check(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_chars=None if t is None else len(t), removed="old", bucket=1) for i, t in rows], "doc_id long, text string, n_chars long, removed string, bucket int").repartition(3)
    out = {r["doc_id"]: r for r in remove_repeated_lines(docs).collect()}
    want = brute(rows)
    assert out.keys() == want.keys()
    for i, (text, gone) in want.items():
        assert (out[i]["text"], out[i]["removed"]) == (text, gone), i
        assert out[i]["n_chars"] == (None if text is None else len(text)) and out[i]["bucket"] == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    check(spark, texts(seed))


def test_repeats_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "q r s"), (None, "t u v"), (2, "C, b; A")], "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in remove_repeated_lines(docs).collect()]
    assert sorted(out, key=str) == sorted([(1, "a b c"), (1, "a b c"), (None, "q r s"), (None, "t u v"), (2, "")], key=str)
    assert remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [Fraction(1, 2), Fraction(9, 10), Fraction(1)])
def test_other_thresholds(spark, share):
    rows = texts(3)[:70] + [(700, "alpha beta"), (701, "alpha beta gamma"), (702, "alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    out = {r["doc_id"]: (r["text"], r["removed"]) for r in remove_repeated_lines(docs, share).collect()}
    assert out == brute(rows, share)


def test_very_long_texts_and_clashing_names(spark):
    """Parts of long texts, lines without end, and columns called like the operator's own."""
    many = "\n".join(f"line {k % 90_000} of w{k % 90_000} words" for k in range(100_000))
    one = "x y z " * 300_000
    names = ["_doc", "_key", "doc", "line", "stay", "lines", "_stay", "_cut", "a"]
    rows = [(1, many, *names), (2, one, *names), (3, "z, y; X\nline 5 of w5 words\n\nline 5 of w5 words", *names)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{x} string" for x in names)]))
    out = {r["doc_id"]: r for r in remove_repeated_lines(docs).collect()}
    assert out[1]["text"] == "\n".join(many.split("\n")[:90_000]) and out[1]["removed"] == list(range(90_000, 100_000))
    assert out[2]["text"] == one and out[3]["text"] == "" and out[3]["removed"] == [0, 1, 3]
    assert all(list(r)[2:-1] == names for r in out.values())


def test_texts_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (1, "g h i"), (1, "d e f\nj k l"), (2, "G H I")], "doc_id long, text string").repartition(2)
    kept = sorted(x for r in remove_repeated_lines(docs).collect() for x in r["text"].split("\n") if x)
    assert [x.lower() for x in kept] == ["a b c", "d e f", "g h i", "j k l"]


def test_a_line_of_a_third_of_all_documents(spark):
    rows = [(i, f"the same line in very many documents\nown words w{i} x{i} y{i}" if i % 3 == 0 else f"own words w{i} x{i} y{i}") for i in range(3000)]
    out = {r["doc_id"]: r["removed"] for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert out == {i: ([0] if i and i % 3 == 0 else []) for i in range(3000)}


def test_words_that_share_half_of_their_hash(spark):
    """The hashes of these two words agree in their upper 32 bits: alone, in longer lines, and in one line."""
    import numpy as np

    from wattline.llm.textkit import span_hash

    one, other = (int(span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([8]))[0]) for w in ("fgnnytlq", "dubioyer"))
    assert one >> 32 == other >> 32 and one != other
    rows = [(1, "fgnnytlq"), (2, "dubioyer"), (3, "a b c d fgnnytlq"), (4, "a b c d dubioyer"), (5, "a b c d fgnnytlq dubioyer"), (6, "q r s fgnnytlq dubioyer"), (7, "q r s fgnnytlq"), (8, "dubioyer fgnnytlq dubioyer"), (9, "fgnnytlq dubioyer fgnnytlq")]
    check(spark, rows)


def test_marked_lines_of_odd_texts(spark):
    rows = [(1, "\n\na b c d e f\n\nx"), (2, ""), (3, "\n"), (4, None), (5, "a b c d e f g\n"), (6, "\na b c d e g"), (7, "é a b c d e f\r\nA B C D E F"), (8, "\n\n")]
    check(spark, rows)
