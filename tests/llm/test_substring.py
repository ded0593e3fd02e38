"""Substring dedup against a plain rolling hash and a dictionary of chunks."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wattline.llm.substring import GEAR, cut_points, dedup_substrings
from wattline.llm.textkit import buffers

BITS, LONGEST, LEAST = 4, 128, 96


def plain_chunks(text):
    raw, h, start, natural = text.encode(), 0, 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(GEAR[b])) & (2**64 - 1)
        last = i + 1 == len(raw)
        if last or (((h & 0xFFFF) >> (16 - BITS)) == 0 and raw[i + 1] & 0xC0 != 0x80):
            natural.append(i + 1)
    out = []
    for end in natural:
        while end - start > LONGEST:
            at = start + LONGEST
            while raw[at] & 0xC0 == 0x80:
                at -= 1
            out.append((start, at))
            start = at
        out.append((start, end))
        start = end
    return raw, out


def brute(rows):
    places, chunks = {}, {}
    for i, text in sorted((i, t) for i, t in rows if t):
        raw, chunks[i] = plain_chunks(text)
        for a, b in chunks[i]:
            places.setdefault(raw[a:b], []).append((i, a))
    out = {}
    for i, text in rows:
        if not text:
            out[i] = (text, 0)
            continue
        raw, gone, total = text.encode(), set(), 0
        for later in (False, True):
            run = []
            for a, b in [*chunks[i], (None, None)]:
                if a is not None and len(places[raw[a:b]]) > 1 and (not later or places[raw[a:b]][0] != (i, a)):
                    run.append((a, b))
                    continue
                if run and run[-1][1] - run[0][0] >= LEAST:
                    total += 0 if later else run[-1][1] - run[0][0]
                    gone |= set(run) if later else set()
                run = []
        out[i] = (b"".join(raw[a:b] for a, b in chunks[i] if (a, b) not in gone).decode(), total)
    return out


def texts():
    rng = random.Random(8)
    words = ["über", "naïve", *(f"{rng.choice('abcdef')}{k}x" for k in range(900))]
    passages = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.choice([0, 5, 80, 200]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randrange(len(body) + 1), rng.choice(passages))
        rows.append((i * 7, " ".join(body)))
    return rows + [(900, None), (901, ""), (902, "é" * 700), (903, "z" * 3000)], passages


def test_cut_points_are_those_of_a_rolling_hash():
    rows, _ = texts()
    column = pa.array([t for _, t in rows])
    data, offsets = buffers(column)
    starts, ends = cut_points(data, offsets, BITS, LONGEST)
    want = [(int(o) + a, int(o) + b) for (_, t), o in zip(rows, offsets) for a, b in (plain_chunks(t)[1] if t else [])]
    assert list(zip(starts.tolist(), ends.tolist())) == want


@pytest.mark.parametrize("least", [2, 10**6])
def test_against_a_dictionary(spark, least):
    """With every repeated digest treated as a common one, and with none."""
    rows, passages = texts()
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "s", [1]) for i, t in rows], "doc_id long, text string, n_chars long, source string, spans array<int>").repartition(4)
    out = {r["doc_id"]: r for r in dedup_substrings(docs, BITS, LONGEST, LEAST, least=least).collect()}
    want = brute(rows)
    assert out.keys() == want.keys()
    for i, (text, total) in want.items():
        assert (out[i]["text"], out[i]["repeated_bytes"]) == (text, total), i
    for i, t in rows:
        raw = (t or "").encode()
        for a, b in reversed(out[i]["spans"]):
            raw = raw[:a] + raw[b:]
        assert raw.decode() == (out[i]["text"] or "")
        hit = t is not None and any(p in t for p in passages)
        assert not hit or out[i]["repeated_bytes"] > 200


def test_repeats_and_empty(spark):
    text = " ".join(f"word{k}" for k in range(200))
    out = [r["text"] for r in dedup_substrings(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()]
    assert out == [text, text]
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert np.array_equal(cut_points(np.zeros(0, np.uint8), np.zeros(3, np.int64), 5, 64)[0], np.zeros(0))
