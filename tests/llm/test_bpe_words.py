"""Words as arrays: no work of Python for each run or each new word, and the library's ids at all borders and limits."""

from __future__ import annotations

import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codeloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["'s", "'re", "'", "''", "'ll", "'d", "'ve'm", "a", "b", "s", "ll", " ", "\n", "12", "!", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "\x85", "\xa0", " ", "Σ", "é", "é", "́", "İ", "漢字", "漢" * 30, "😀", "x" * 15, "x" * 16, "x" * 64, "x" * 65, "ab" * 8, "\0", "\0\0", "²", "Ⅷ", "Ᲊ", "Ƛ", "Å", "DON'T", ".", "%%%"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_new_words_take_no_steps_of_python():
    """Calls of functions, also of C, while some 60,000 words of at most 15 bytes are encoded, all of them new: less than one for each."""
    rng = random.Random(4)
    parts = ("th", "on", "er", "ing", "a", "é", "wh", "at", "ou", "ly", "es", "in", "ti", "re", "de")
    words = {"".join(rng.choice(parts) for _ in range(5)) for _ in range(65_000)}
    texts = [" ".join(sorted(words))]
    encoder, calls = bpe.WordBpe(PATH, decoding=False), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        encoder.encode_decode(texts)
    finally:
        sys.setprofile(None)
    assert calls < len(words)


@pytest.mark.parametrize("limits", [{}, {"WORDS": 40, "PREFIXES": 50, "REMEMBERED": 300, "TOGETHER": 7, "AT_ONCE": 30}])
def test_like_library(monkeypatch, tokenizer, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(1500)]
    encoder, got = bpe.WordBpe(PATH), []
    for k in range(0, len(texts), 200):
        got += encoder.encode_decode(texts[k : k + 200])
    for text, (data, n, decoded) in zip(texts, got, strict=True):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert (np.frombuffer(data, "<u4").tolist(), n, decoded) == (ids, len(ids), tokenizer.decode(ids, skip_special_tokens=False)), text


def test_other_patterns():
    """A pattern that the kinds of characters don't tell is run over the text."""
    encoder, plain = bpe.WordBpe(PATH), bpe.WordBpe(PATH)
    plain.by_kind = False
    texts = ["It's 12 o'clock, naïve \"don't'll\"!", "", " ", "漢字 x"]
    assert encoder.encode_decode(texts) == plain.encode_decode(texts)


def test_memory_tells_all_keys_apart():
    rng = np.random.default_rng(6)
    a, b = np.unique(rng.integers(0, 200, (3000, 2)).astype(np.uint64), axis=0).T
    memory = bpe._Memory(2, bits=4)
    for k in range(0, len(a), 100):
        memory.put(np.arange(k, min(k + 100, len(a)), dtype=np.int32), a[k : k + 100], b[k : k + 100])
    assert memory.get(a, b).tolist() == list(range(len(a)))
    assert (memory.get(a + np.uint64(200), b) == -1).all()
