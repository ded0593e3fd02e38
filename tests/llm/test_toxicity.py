"""Toxicity: decoding by hand-made cases and against all readings; scoring by held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wattline.llm.textkit import buffers
from wattline.llm.toxicity import Restorer, _pieces, char_class, language_model, restored, score_toxicity

WORDS = ["river", "stone", "winter", "garden", "silver", "letter", "summer", "mountain", "harbour", "village", "idiot", "trash", "worthless", "market", "season", "and", "the", "a", "of", "été"]
BAD = ["idiot", "trash", "worthless"]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(200))) for i in range(60)] + [(99, None), (98, "")]
    return language_model(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("text, want", [
    ("an 1d10t here", "an idiot here"), ("tr@sh", "trash"), ("w0rthl3ss", "worthless"), ("i d i o t", "idiot"), ("such i.d.i.o.t!", "such idiot!"),
    ("idiooot", "idiot"), ("plain words stay", "plain words stay"), ("", ""), ("12 345", "12 345"), ("été", "été"), ("sum!", "sum!"),
])
def test_restores(model, text, want):
    assert restored(pa.array([text]), Restorer(model)).to_pylist() == [want]


def test_viterbi_is_the_best_of_all_readings(model):
    r = Restorer(model)

    def score(path):
        a = b = 0
        total = 0.0
        for emitted, cost in path:
            total -= cost
            for c in emitted:
                z = char_class(c)
                if not (z == 0 and b == 0):
                    total += model[a][b][z]
                a, b = b, z
        return total + (model[a][b][0] if b else 0)

    for piece in ("1d10t", "s1lv3r", "t r a s h", "leeetter", "$t0ne", "a b c"):
        best = max(itertools.product(*r.lattice(piece)), key=score)
        assert abs(score(best) - max(score(p) for p in itertools.product(*r.lattice(piece)))) < 1e-9
        assert r.decode(piece) == "".join(x for x, _ in best)


def test_stretches_cover_what_decoding_changes(model):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1$ .é!e\n") for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(300)]
    r = Restorer(model)
    assert restored(pa.array(texts), r).to_pylist() == [restored(pa.array([t]), r)[0].as_py() for t in texts]
    starts, ends = _pieces(*buffers(pa.array(texts)))
    assert (starts <= ends).all()


def test_scores_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice([w for w in WORDS if w not in BAD]) for _ in range(60)]
        if toxic:
            bad = rng.choice(BAD)
            words[rng.randrange(60)] = bad if i % 8 else bad.replace("i", "1").replace("o", "0").replace("a", "@")
        rows.append((i, " ".join(words), "en", 1.0))
        labels.append((i, int(toxic)))
    rows += [(900, None, None, 0.0), (901, "", "en", 0.0), (None, "an idiot", "en", 0.0), (0, rows[0][1], "en", 1.0)]
    labels += [(1, None), (None, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = score_toxicity(docs, marks).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert [r["predicted"] for r in out if r["doc_id"] in (900, 901)] == [0, 0]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in score_toxicity(docs, none).collect()] == [0, 0]
    assert score_toxicity(docs.limit(0), none).count() == 0
