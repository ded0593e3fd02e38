"""Piecewise hashing against a byte-by-byte computation."""

import hashlib
import random

import numpy as np
import pytest

from wattline.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, key string, part string, role string, copies string, n_chars long"


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain(text):
    """The fingerprint, a byte at a time; pieces are hashed by the same primitive one by one."""
    raw, size = text.encode(), 1
    while len(text) > 64 * size:
        size *= 2
    out = []
    for n in (size, 2 * size):
        pieces, start = [], 0
        for i in range(len(raw)):
            window = raw[max(0, i - 6) : i + 1][::-1]
            h = mix(sum((b + 1) * 0x9E3779B97F4A7C15**k for k, b in enumerate(window)) % 2**64)
            if h % n == 0 or i == len(raw) - 1:
                pieces.append(raw[start : i + 1])
                start = i + 1
        code = [int(fp.span_hash(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0]) >> 52 for p in pieces]
        out.append("".join(fp.ALPHABET[c >> 6] + fp.ALPHABET[c & 63] for c in code))
    return f"{size}:{out[0]}:{out[1]}"


def edit(p, q):
    """Insertions and deletions from one list to the other."""
    row = list(range(len(q) + 1))
    for i, x in enumerate(p, 1):
        last, row = row, [i]
        for j, y in enumerate(q, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[j - 1]))
    return row[-1]


def plain_likeness(one, other):
    if one == other:
        return 1.0
    (s, *a), (t, *b) = one.split(":"), other.split(":")
    sizes = {(int(s) * k): x for k, x in zip((1, 2), a)}, {(int(t) * k): x for k, x in zip((1, 2), b)}
    both = sorted(sizes[0].keys() & sizes[1].keys())
    if not both:
        return 0.0
    p, q = ([x[i : i + 2] for i in range(0, len(x), 2)] for x in (sizes[0][both[0]], sizes[1][both[0]]))
    return 1 - edit(p, q) / (len(p) + len(q)) if p and q else 0.0


def make(rng, chars):
    return "".join(rng.choice(["a", "b", " ", "é", "日", "\U0001f600", "the ", "\n"]) for _ in range(chars))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return [make(rng, n) for n in (0, 1, 2, 3, 6, 7, 8, 63, 64, 65, 128, 129, 700, 3000)] + ["", "x" * 500, "ab" * 900]


def test_fingerprints_equal_a_plain_computation(texts, monkeypatch):
    want = [plain(t) for t in texts]
    assert fp.fingerprints(texts) == want
    for part in (16, 100, 1000):  # texts of several parts, and parts of several texts
        monkeypatch.setattr(fp, "LONG", part)
        assert fp.fingerprints(texts) == want


def test_likeness_equals_edit_distance(texts):
    rng = random.Random(9)
    found = fp.fingerprints(texts + [t[: len(t) // 2] + make(rng, len(t) // 3) for t in texts])
    for one in found:
        for other in found:
            assert fp.likeness(one, other) == pytest.approx(plain_likeness(one, other), abs=1e-12)


def test_insertions_leave_most_pieces_alone():
    rng = random.Random(3)
    for n in (400, 5000, 90_000):
        text = make(rng, n)
        moved = text[: n // 3] + "inserted words " + text[n // 3 :]
        one, other, far = fp.fingerprints([text, moved, make(rng, n)])
        assert fp.likeness(one, other) > 0.8 and fp.likeness(one, far) < 0.2


def brute(rows):
    """Rows in order, each followed by the next; the hash that orders rows of one id is Spark's, passed in."""
    ordered = sorted(((i is None, i or 0, h, t or "") for i, t, h in rows))
    out = []
    for k, (no, i, _, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][3]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        p, q, r = fp.fingerprints([text, new, following])
        out.append((-1 if no else i, len(text), hashlib.sha256(new.encode()).hexdigest(), p, q, fp.likeness(p, q), fp.likeness(p, r)))
    return sorted(out)


def check(spark, rows, **settings):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "k", "p", "r", "c", 3) for i, t in rows], SCHEMA).repartition(3)
    hashed = [(r[0], r[1], r[2]) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    out = fp.fingerprint_edits(df, **settings)
    assert out.columns == [x.split()[0] for x in fp.TOLD.split(", ")]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out.collect()) == brute(hashed)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rows_equal_a_plain_computation(spark, texts, parts):
    rng = random.Random(1)
    rows = [(3 * k, t) for k, t in enumerate(texts)] + [(1000 + k, make(rng, rng.choice([5, 50, 300]))) for k in range(60)]
    rows += [(None, None), (None, "no id"), (9, None), (9, "same id"), (9, "same id"), (12, texts[4]), (-5, "negative " * 9), (2**62, "far " * 7)]
    check(spark, rows, parts=parts)


def test_rows_that_repeat_very_often(spark):
    rng = random.Random(2)
    rows = [(k, make(rng, 30)) for k in range(50)] + [(20, "again " * 5)] * 6000 + [(None, None)] * 1500 + [(70, "z")] * 20
    check(spark, rows, parts=6)


def test_one_row_none_and_a_very_long_text(spark):
    check(spark, [(1, "only one document")])
    check(spark, [])
    rng = random.Random(6)
    long = make(rng, 1000) * 3000
    check(spark, [(1, long), (2, "short"), (3, long + "!")])
