"""Packing: ids against the tokenizer itself, and pieces against the arithmetic."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wattline.llm.packing import Encoder, binary_pieces, default_tokenizer, pack_by_powers_of_two

TRICKY = [
    "", " ", "Hello, World!! it's we'll DON'T", "ÉÈ été ñandú Straße ẞ İstanbul ΣΑΣ ǰ J̌ é", "a_b 12 3.14 (555) x@y.z <|endoftext|> end",
    "naïve space wide\ttab\r\nline", "of%%% the*** !!!", "日本語 テキスト", "word" * 400, "́ lone", "ﬁ ligature Ⅷ ²",
]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer(), most=50)


def plain(encoder, text):
    return np.array(encoder.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_the_tokenizers(encoder, text):
    assert encoder.ids(text) == plain(encoder, text)
    assert encoder.ids(text + " " + text) == plain(encoder, text + " " + text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzEÉéñßΣσİ \n\t.,!'sd1²_|́ "), max_size=40))
def test_ids_of_any_text(text):
    encoder = _shared()
    assert encoder.ids(text) == plain(encoder, text)


_kept = []


def _shared():
    if not _kept:
        _kept.append(Encoder(default_tokenizer()))
    return _kept[0]


@given(st.integers(1, 60_000), st.sampled_from([1, 8, 4096]))
def test_binary_pieces(n, longest):
    pieces = binary_pieces(n, longest)
    assert pieces[0][0] == 0 and sum(x for _, x in pieces) == n
    assert all(a + x == b for (a, x), (b, _) in zip(pieces, pieces[1:]))
    assert all(x & (x - 1) == 0 and x <= longest for _, x in pieces)


def test_packs_every_id_once(spark, encoder):
    rows = [(1, "The quick brown fox. " * 60, "x"), (2, None, None), (3, "", "y"), (4, "same", "z"), (4, "same", "z"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    out = pack_by_powers_of_two(docs, longest=64).collect()
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
    assert [r["length"] for r in sorted(out, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in out), reverse=True)
    for doc, text, _ in rows[:3]:
        data = plain(encoder, text or "") + np.array([2], "<u4").tobytes()
        mine = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [(r["start"], r["length"]) for r in mine] == binary_pieces(len(data) // 4, 64)
        assert all(r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["doc_tokens"] == len(data) // 4 and r["offset"] == 0 for r in mine)
    assert sum(r["doc_id"] == 4 for r in out) == 2 * sum(1 for _ in binary_pieces(len(plain(encoder, "same")) // 4 + 1, 64))


def test_empty_table(spark):
    assert pack_by_powers_of_two(spark.createDataFrame([], "doc_id long, text string")).count() == 0
