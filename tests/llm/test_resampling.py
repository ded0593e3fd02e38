"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from wattline.llm.resampling import resample_by_importance

SCHEMA = "doc_id long, text string, place int, words string, gain string, rank long, copies string"


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets, percent, least):
    s, t = (Counter(g % buckets for x in texts for g in grams(x)[1]) for texts in ([x for _, x in docs], target))
    whole, target_whole = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (whole + buckets) / ((s[b] + 1.0) * (target_whole + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        n, found = grams(text)
        u = (int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[g % buckets] for g in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, n >= least])
    enough = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(enough[: len(enough) * percent // 100], 1):
        r[4] = place
    return rows


def rows_of(docs):
    return [(i, text, 1, "w", "g", 7, "c") for i, text in docs]


def ordered(rows):
    return sorted((tuple(r[:5]) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "été", "数据", "don't", "x1", "42", "GAMMA-ray", "o_o", "z"]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 19, 20, 21, 60])))
    docs = [(i, text()) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "-- ,, \n"), (None, text()), (None, None), (503, "İ\U0001f600 ẞ " * 30)]
    docs += [(7, "another text of the same id " * 6)] + [docs[3]] * 3 + [(600, "alpha beta " * 20)] * 90  # ids that share, exact repeats
    return docs, [text() for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_rows_equal_a_plain_computation(spark, tables, percent):
    docs, target = tables
    out = resample_by_importance(spark.createDataFrame(rows_of(docs), SCHEMA).repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), 97, percent)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {kind for _, kind in out.dtypes} == {"bigint"}
    assert ordered(out.collect()) == ordered(brute(docs, target, 97, percent, 20))


def test_copies_beyond_one_run_are_drawn_one_by_one(spark, monkeypatch, tables):
    from wattline.llm import resampling

    monkeypatch.setattr(resampling, "RUN", 7)
    docs, target = tables
    out = resample_by_importance(spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame([(x,) for x in target], "text string"), 97, 80)
    assert ordered(out.collect()) == ordered(brute(docs, target, 97, 80, 20))


def test_empty_tables_and_a_very_long_text(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("alpha beta",)], "text string")
    assert resample_by_importance(none, some).count() == 0
    long = "word and Another " * 120_000
    docs = [(1, long), (2, "alpha beta " * 12)]
    out = resample_by_importance(spark.createDataFrame(rows_of(docs), SCHEMA), none.select("text"), 97, 50)
    assert ordered(out.collect()) == ordered(brute(docs, [], 97, 50, 20))


def test_only_dataframe_functions(spark, tables, monkeypatch):
    def forbidden(*args, **more):
        raise AssertionError("Python in the plan")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(1)), name, forbidden)
    docs, target = tables
    out = resample_by_importance(spark.createDataFrame(rows_of(docs), SCHEMA), spark.createDataFrame([(x,) for x in target], "text string"))
    assert "Python" not in out._jdf.queryExecution().toString()
