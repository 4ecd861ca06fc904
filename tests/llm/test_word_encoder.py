"""The packing encoder gives the library's ids, also when its memory is full."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordsmith.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = ["", "  ", "Hello, hello world. x,y ...", "a b's don't 'RE it's, 12½ 007", "İstanbul Straße ǅ ﬁ é", "日本語 word​x", "\x00 \x1c a\x85b\xa0c", "..'s a'b ?! ,' x;:.", "<|endoftext|> x <|STARTOFTEXT|>", "verbaqueth " * 3000]


@pytest.mark.parametrize("memo", [0, 3, 600_000])
def test_ids_equal_the_library(monkeypatch, memo):
    monkeypatch.setattr(packing, "MEMO", memo)
    library, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    library.no_truncation()
    library.no_padding()
    expected = [packing.array("I", e.ids).tobytes() for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(2):  # fresh, then remembered
        assert encoder.encode(TEXTS) == expected
    assert [encoder.encode([t])[0] for t in TEXTS] == expected
    assert encoder.encode([]) == []
