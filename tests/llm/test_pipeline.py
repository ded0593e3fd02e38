"""The pipeline against a plain computation of all its stages."""

import random

import corpus_pipeline
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_neardup import brute as near_brute
from wattline.llm.packing import Encoder, binary_pieces, default_tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows():
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "te", "su", "no") for c in ("b", "d", "g", "l")]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([6, 12, 30])))
    common = line()
    rows = []
    for i in range(60):
        text = "\n".join([line() for _ in range(rng.choice([1, 2, 4]))] + ([common] if i % 3 == 0 else []))
        rows.append((2 * i, text, rng.choice(["en", "fr"]), "hot" if i % 3 else f"s{i % 4}", len(text)))
    copies = [(2 * k + 1001, rows[k][1] + rng.choice(["", " extra"]), "en", "s1", 0) for k in range(0, 60, 7)]
    return rows + copies + [(5000, None, "en", "s1", None), (5001, "", "en", None, 0), (5002, "12 !!", None, "s2", 5)]


def test_stages_and_run(spark, tmp_path):
    rows = make_rows()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out_{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out_{name}"))
        after[name] = docs
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    told = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert sorted(r["doc_id"] for r in after["language_id"].collect()) == sorted(i for i, _ in told)
    lines = {i: text for i, (text, _) in lines_brute(told).items()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after["line_dedup"].collect()}
    assert {i: t for i, (t, _) in got.items()} == lines and all(n == len(t) for i, (t, n) in got.items() if lines[i] != dict(told)[i])
    classes = near_brute(sorted(lines.items()))
    assert sorted(r["doc_id"] for r in after["near_dedup"].collect()) == sorted(i for i, c in classes.items() if i == c)
    kept = sorted((r["doc_id"], r["text"]) for r in after["near_dedup"].collect())
    assert sorted((r["doc_id"], r["text"]) for r in after["mixing"].collect()) == kept
    encoder = Encoder(default_tokenizer())
    want = sorted((i, *piece) for i, t in kept for piece in binary_pieces(len(encoder.ids(t)) // 4 + 1, 4096))
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in after["packing"].collect()) == want
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
