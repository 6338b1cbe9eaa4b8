"""Vectorised word and shingle hashes of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time, but for single texts that are longer.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) < CHUNK:
            n += len(texts[end])
            end += 1
        yield from _chunk(texts[at:end])
        at = end


def _chunk(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        for _ in texts:
            yield np.empty(0, np.uint64)
        return
    index = np.arange(len(data), dtype=np.int64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    index -= np.maximum.accumulate(first)
    index[space] = 0
    powers = np.empty(int(index.max()) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _STEP
    np.multiply.accumulate(powers, out=powers)
    hashes = mix(np.add.reduceat(_TABLE[data] * powers[index], starts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, ends)
    at = 0
    for b in bounds:
        yield hashes[at:b]
        at = b


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; with fewer words, of the whole sequence; without words, none."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out + words[i : n - k + 1 + i] * _PLACE[i % 5] + np.uint64(i // 5))
    return np.unique(out)
