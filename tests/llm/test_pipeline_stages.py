"""Every stage counts, and takes odd rows, empty tables and any extra columns."""

import random

import pytest

import corpus_pipeline

STEMS = {"en": "wht thk ckw", "de": "sch eiz tzt", "fr": "eau oui quo"}
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(n):
    """Texts of three languages with a common word, every other one of one source."""
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        out.append((i, "zq " + " ".join(rng.choice(STEMS[lang].split()) + rng.choice(STEMS[lang].split()) + rng.choice("abc") for _ in range(40)), lang, "hot" if i % 2 else f"s{i % 3}"))
    return out


def test_the_language_stage_follows_the_model(spark):
    rows = rows_of(900) + [(1000, "zq", None, "x"), (1001, None, "en", "x"), (1002, "", "en", "x"), (1003, "12 .. 34", "en", "x"), (1004, "scheiz eiztzta", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    kept = {r["doc_id"] for r in STAGES["language_id"](spark, docs, "").collect()}
    # A word of all languages tells none of them; all else is kept.
    assert kept == set(range(900)) | {1004}
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source")
    assert {r["doc_id"] for r in STAGES["language_id"](spark, unlabelled, "").collect()} == kept | {1000}


def test_every_stage_takes_odd_tables(spark):
    """Columns called like those of the operators, nulls in all columns, repeated rows, and no rows."""
    names = ["lang_pred", "score", "has_letters", "_row", "_key", "_told", "removed", "doc", "class_id", "position", "_doc", "count"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names)
    rows = [(i, t, lang, s, len(t), *names) for i, t, lang, s in rows_of(40)]
    odd = [rows[5], (None, None, None, None, None, *[None] * len(names)), (None, "ohne id scheiz", "de", None, 1, *names), (7, "another text of one id whth", "en", "hot", 2, *names)]
    for table in (rows + odd, []):
        docs = spark.createDataFrame(table, schema).repartition(2)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "packing":
                assert out.columns == docs.columns, name
                # Lines that repeat others go, and of near copies one stays; all other columns are as they were.
                found = [tuple(r)[5:] for r in out.collect()]
                assert len(found) <= len(table) and all(x in (tuple(names), (None,) * len(names)) for x in found)
            assert out.count() >= (len(rows) // 2 if table else 0), name
            assert table or out.count() == 0


def packed(spark, folder):
    return {(r["doc_id"], r["start"], r["ids_crc32"]): r["sequence_id"] for r in corpus_pipeline.run(spark, folder).collect()}


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A folder of documents on which every stage has something to do, and the result of all stages."""
    same = " ".join(f"whck{c}" for c in "abcdefghijklmnopqrst")
    rows = [*rows_of(60), (500, "zq", None, "x"), (501, same + "\nthwha first end of two", "en", "x"), (502, same + "\nckwhb other end", "en", "s1")]
    # One text in lines of twelve words, cut at other places: no line is near another, the texts are the same.
    words = [f"v{k}" for k in range(120)]
    lines = lambda at: "\n".join(" ".join(x) for x in ([words[:at]] if at else []) + [words[k : k + 12] for k in range(at, 120, 12)])
    rows += [(600, lines(0), "en", "x"), (601, lines(6), "en", "x")]
    folder = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    return folder, packed(spark, folder)


@pytest.mark.parametrize("left_out", ["language_id", "line_dedup", "near_dedup", "mixing"])
def test_the_result_changes_without_a_stage(spark, whole, monkeypatch, left_out):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] != left_out])
    without = packed(spark, whole[0])
    if left_out == "mixing":  # it decides the order, and takes nothing out
        assert without.keys() == whole[1].keys() and without != whole[1]
    else:
        assert without.keys() != whole[1].keys()


def test_the_mixture_numbers_the_sequences(spark, whole, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "MIXTURE", {"weights": {"hot": 9.0}, "block_bytes": 200})
    other = packed(spark, whole[0])
    assert other.keys() == whole[1].keys() and other != whole[1]
