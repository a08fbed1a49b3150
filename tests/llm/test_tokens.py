import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import tokens

PARTS = ["a", "B", "é", " ", "  ", "\n", "\n\n", "'s", "'", "!", "1", "23", "×", "É", "the", ".", ",", "\t", "\r", "\x1c", "\x85", "日", "ß",
         "é", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "😀", "don't", "µ", " 'x'"]


@pytest.mark.parametrize("name", sorted(tokens.LAYOUTS))
def test_ids_equal_the_library(name):
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), tokens.Encoder(name, parts=50, pieces=30)
    rng = random.Random(5)
    held = ["".join(rng.choice(PARTS[:rng.choice([15, 40])]) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    for text in [*held, "word " * 30_000, " " * 5000, "x" * 5000]:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_a_vocabulary_without_layout():
    own = tokens.Encoder("byte_bpe_50k.json")
    own.layout = None
    assert own.ids("plain words").tolist() == own.library.encode("plain words", add_special_tokens=False).ids
