"""Ids of texts with the strings of added tokens, odd characters and other tokenizers, against the tokenizer itself."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tessera.llm import packing
from tessera.llm.common import utf8

PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "foo", "Bar", "don't", "it'S", "'ll", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "12", "3.5", "É", "e\u0301", "A\u0301", "İ", "ß", "漢字", "a,b", "x-y", "!!", "\x00", "\x1c", "", "ﬁ", "Ω", "🙂", "..."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    assert encoder.by_words == (name == "word_bpe_49k.json")
    truth = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["<|endof", "text|>", "ab" * 3000, None, ""]
    for lo in range(0, len(texts), 50):
        part = texts[lo : lo + 50]
        flat, begin = packing.token_ids(*utf8(pa.array(part, pa.string())), encoder)
        got = [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        assert got == [truth.encode(t or "", add_special_tokens=False).ids for t in part]


def test_empty_slice():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    flat, begin = packing.token_ids(np.zeros(0, np.uint8), np.zeros(3, np.int64), encoder)
    assert len(flat) == 0 and begin.tolist() == [0, 0, 0]
