"""Control characters that str.split() drops and the tokenizer keeps."""

import pytest

from tests.llm.test_packing import encoder, plain  # noqa: F401


@pytest.mark.parametrize("mark", "\x1c\x1d\x1e\x1f\x85\xa0 \x0b")
def test_ids_around_separators(encoder, mark):  # noqa: F811
    for text in (f"a{mark}b", f"Hello {mark} world!", f"{mark}it's", mark):
        assert encoder.ids(text) == plain(encoder, text)
