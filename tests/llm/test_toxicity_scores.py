"""Toxicity scores against a plain computation on the restored texts: counts in dictionaries, the logistic model by its own equations."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from wattline.llm.toxicity import score_toxicity

WORDS = ["river", "stone", "winter", "garden", "silver", "letter", "summer", "mountain", "harbour", "village", "market", "season", "and", "the", "of", "été"]
BAD = ["idiot", "idiotic", "trash", "worthless"]


def features(word):
    raw = word.encode()
    return [("whole", raw), ("four", raw[:4]), ("five", raw[:5])]


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text)


def plain_scores(restored, toxic):
    """Scores of all restored texts (by id), learned from the labels ``toxic`` (by id)."""
    seen, bad, rows = {}, {}, [0, 0]
    for i, label in toxic.items():
        rows[0] += 1
        rows[1] += label
        for f in {f for w in words(restored[i]) for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
            bad[f] = bad.get(f, 0) + label
    base = (rows[1] + 0.5) / (rows[0] + 1)
    weight = {}
    for f, n in seen.items():
        z = (bad[f] - n * base) / math.sqrt(n * base * (1 - base))
        if bad[f] >= 4 and z >= 5:
            weight[f] = max(0.0, math.log((bad[f] + 0.5) / (n - bad[f] + 0.5)) - math.log(base / (1 - base)))

    def row(text):
        found = words(text)
        best = [(max(weight.get(f, 0.0) for f in features(w)), w) for w in found]
        mine = [(b, w) for b, w in best if b > 0]
        if not mine:
            return [1, 0, 0, 0, 0, 0]
        top = sorted({w: b for b, w in mine}.values(), reverse=True)
        return [1, 1, top[0], sum(top[:5]), min(5, len(top)), math.log((1 + len(mine)) / (1 + len(found)))]

    x = np.array([row(restored[i]) for i in toxic], float)
    y = np.array(list(toxic.values()), float)
    penalty = np.array([1e-6] + [1.0] * 5)
    w = np.zeros(6)
    for _ in range(60):  # where the penalised likelihood has no slope
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (y - p) - penalty * w
        w = w + np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)) @ slope
    assert np.abs(slope).max() < 1e-6
    return {i: 1 / (1 + math.exp(-float(np.dot(row(t), w)))) for i, t in restored.items()}


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        text = [rng.choice(WORDS) for _ in range(rng.choice([3, 12, 30]))] + ([rng.choice([*BAD, "1d10t", "tr@sh", "w o r t h l e s s"]) for _ in range(rng.choice([1, 2, 7]))] if bad or i % 41 == 1 else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "idiot " * 50)]
    out = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), carry_text=True).collect()
    restored = {r["doc_id"]: r["restored_text"] for r in out}
    assert any("idiot" in restored[i].split() and "idiot" not in (t or "").split() for i, t in rows)
    learned = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    want = plain_scores(restored, learned)
    for r in out:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-4, abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert min(r["score"] for r in out if r["doc_id"] % 5 == 0 and r["doc_id"] < 400) > max(want[i] for i in (1000, 1001))
