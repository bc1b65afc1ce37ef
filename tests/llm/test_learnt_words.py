"""Words that are parts of others are asked for once, and give the tokenizer's ids."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helixframe.llm import packing


@pytest.mark.parametrize("text", ["zorgle zorgle, zorgle. it's s 's 12 1 2 zorgle,zorgle , ,, x1 x", "quux, vroom", "vroom quux.", "Über über, ÜBER"])
def test_ids_are_the_tokenizers(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = packing.word_encoder(path)
    for _ in range(2):
        assert encode([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
