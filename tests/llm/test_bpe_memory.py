"""What each worker holds for the encoder: the vocabulary as arrays, and a bounded memory of words."""

from __future__ import annotations

import random
import tracemalloc

import public_tokenizers

from codeloom.llm import bpe

PARTS = ("th", "on", "er", "ing", "a", "é", "wh", "at", "ou", "ly", "es", "in", "ti", "re", "de")


def test_memory_of_a_worker():
    """MB after loading (79 with mappings of Python objects) and at most while 195,000 words are encoded, nearly all new (180 then)."""
    rng = random.Random(7)
    tracemalloc.start()
    try:
        encoder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), decoding=False)
        assert tracemalloc.get_traced_memory()[0] < 40e6
        for _ in range(3):
            encoder.encode_decode([" ".join("".join(rng.choice(PARTS) for _ in range(6)) for _ in range(65_000))])
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
