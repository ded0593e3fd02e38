"""Restoring by stretches against restoring whole texts, and obfuscations that need every leetspeak character."""

import random

import pyarrow as pa
import pytest

from tests.llm.test_toxicity import model  # noqa: F401
from wattline.llm.toxicity import LEET, Restorer, restored


@pytest.mark.parametrize("text, want", [
    ("! d ! o t", "idiot"), ("i d i o +", "idiot"), ("+ r a s h", "trash"), ("an “i d i o t” here", "an “idiot” here"),
    ("idio7", "idiot"), ("worthle55", "worthless"), ("worthle$$", "worthless"), ("sum!", "sum!"), ("river!!!", "river!!!"), ("stone 55", "stone 55"),
    ("i  d  i  o  t", "idiot"), ("t\tr\ta\ts\th", "trash"), ("idi-ot", "idiot"), ("tra*sh", "trash"), ("iiddiioott", "idiot"), ("river-stone", "river-stone"), ("a   b", "a   b"),
])
def test_restores_more(model, text, want):  # noqa: F811
    assert restored(pa.array([text]), Restorer(model)).to_pylist() == [want]


def test_stretches_equal_whole_texts(model):  # noqa: F811
    rng = random.Random(7)
    r = Restorer(model)
    for alphabet in ("ab1! .", "".join(LEET) + "abé“”— .-_*\n²٣日", "a $.b!c", "aaé77_ x", "aab- _*\t", "abcd-"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))) for _ in range(4000)]
        assert restored(pa.array(texts), r).to_pylist() == [r.restore(t) for t in texts]


def test_long_texts_come_in_parts(model):  # noqa: F811
    text = "the riv3r and a st0ne\n" * 60_000
    texts = pa.array([text, None, "1d10t"])
    assert restored(texts, Restorer(model)).to_pylist() == ["the river and a stone\n" * 60_000, "", "idiot"]
