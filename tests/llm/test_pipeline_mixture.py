"""The mixture decides the order of the pipeline's sequences."""

import corpus_pipeline
from wattline.llm.mixing import places, schedule_mix
from wattline.llm.packing import default_tokenizer, encoder, pack_by_powers_of_two
from wattline.llm.slots import with_layout

COLUMNS = "doc_id long, text string, source string"


def tokens(text):
    return len(encoder(default_tokenizer()).ids(text or "")) // 4 + 1


def test_sequences_follow_the_mixture(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 9)), f"s{i % 3}") for i in range(300)] + [(None, None, None), (7, "another text", "s1")]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    size = {(i, t): len((t or "").encode()) + 1 for i, t, _ in rows}
    orders = []
    for n, weights in enumerate(({"s0": 8.0, "s1": 1.0, "s2": 1.0}, {"s0": 1.0, "s1": 1.0, "s2": 8.0})):
        mixture = {"weights": weights, "block_bytes": 100}
        at = {(r["doc_id"], r["size"]): r["position"] for r in schedule_mix(docs, **mixture).collect()}
        assert len(at) == len(size) == len(rows)
        place = {(i, tokens(t)): at[i, size[i, t]] for i, t, _ in rows}
        monkeypatch.setattr(corpus_pipeline, "MIXTURE", mixture)
        corpus_pipeline.mix_stage(spark, docs, "").write.parquet(str(tmp_path / f"mixed{n}"))
        out = sorted(corpus_pipeline.pack_stage(spark, spark.read.parquet(str(tmp_path / f"mixed{n}")), "").collect(), key=lambda r: r["sequence_id"])
        assert [r["sequence_id"] for r in out] == list(range(len(out)))
        keys = [(-r["length"], place[r["doc_id"], r["doc_tokens"]]) for r in out]
        assert keys == sorted(keys)
        orders.append([(r["doc_id"], r["start"]) for r in out])
        again = places(docs.repartition(2), **mixture)
        assert {tuple(r) for r in again.collect()} == {tuple(r) for r in places(docs.coalesce(1), **mixture).collect()}
    assert orders[0] != orders[1] and sorted(orders[0], key=str) == sorted(orders[1], key=str)


def test_layouts(spark, tmp_path):
    """Of files, by name and row; of anything else, by partition; columns may have any names."""
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "1 as _file", "2 as _number", "3 as _other")
    df.write.parquet(str(tmp_path / "t"))
    for table in (spark.read.parquet(str(tmp_path / "t")), df):
        placed, bound = with_layout(table, "at")
        found = [(r["at"], r["id"]) for r in placed.collect()]
        assert [i for _, i in sorted(found)] == list(range(1000)) and max(a for a, _ in found) < bound and placed.columns == [*df.columns, "at"]


def test_positions_order_a_bucket(spark):
    docs = spark.createDataFrame([(i, f"word{i % 4}", 99 - i) for i in range(100)], "doc_id long, text string, own long")
    out = sorted(pack_by_powers_of_two(docs, position="own", positions=100).collect(), key=lambda r: r["sequence_id"])
    keys = [(-r["length"], 99 - r["doc_id"]) for r in out]
    assert keys == sorted(keys)


def test_weights_change_what_run_gives(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(6)), f"s{i % 3}") for i in range(60)]
    spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = []
    for weights in ({"s0": 8.0, "s1": 1.0, "s2": 1.0}, {"s0": 1.0, "s1": 1.0, "s2": 8.0}):
        monkeypatch.setattr(corpus_pipeline, "MIXTURE", {"weights": weights, "block_bytes": 50})
        got.append({(r["doc_id"], r["start"]): r["sequence_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})
    assert got[0].keys() == got[1].keys() and got[0] != got[1]
