"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding.

A merge list defines, for every string, one encoding. Let last(i) be the last token of the encoding of the string's
first i symbols. It is the one token t ending at i such that t alone encodes to itself and, unless it starts the
string, t may follow last(i - len(t)): the pair's concatenation encodes to just that pair. So last() is filled from
left to right, one unique token for every prefix, and the ids are read off from the end by back-pointers. Tokens that
end at a place are found by a suffix automaton of the vocabulary.

Texts are worked on as arrays, many at once: words are found by the kinds of their characters and looked up by their
bytes; of words not met before only the prefixes that no other word had are worked out.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import prepare, remembers

#: Pairs, and prefixes of long words, remembered by each worker, at most.
REMEMBERED = 200_000
#: Words remembered by each worker, at most but for those of one step (some 60 bytes each).
WORDS = 200_000
#: Prefixes of words remembered by each worker, at most but for those of one step (some 50 bytes each).
PREFIXES = 500_000
#: Words of more bytes are looked up one by one.
SHORT_WORD = 15
#: Words of more bytes are encoded one by one.
LONG_WORD = 64
#: Characters of text that are encoded together, but for longer runs without white space.
AT_ONCE = 1_000_000
#: Words that are encoded together, and characters whose kinds are looked up together.
TOGETHER = 65_536
#: How words are split where their kinds of characters tell all; other patterns are run over the text.
_BY_KIND = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of characters: white space (by Unicode, so without the ASCII separators), letter, digit, sign, not looked up yet.
_SPACE, _LETTER, _NUMBER, _SIGN, _UNKNOWN = range(5)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies -> the byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Capitals of Unicode 16 and 17, which the library knows and Python doesn't yet, and their small letters.
_NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW = np.array(sorted(_NEW_CAPITALS), np.uint32)
# What of the first and the second eight bytes belongs to a word of so many bytes.
_FIRST = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], np.uint64)
_SECOND = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(16)], np.uint64)


class _Table:
    """Hash table from non-negative integers to non-negative integers for arrays of keys; -1 for those it lacks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]], self.values[at[free]] = keys[left[free]], values[left[free]]
            missed = self.keys[at] != keys[left]
            left, at = left[missed], (at[missed] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def one(self, key: int) -> int:
        """get() of a single key, without arrays."""
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 64 - self.bits
        while (found := self.keys.item(at)) != key:
            if found < 0:
                return -1
            at = at + 1 & len(self.keys) - 1
        return self.values.item(at)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = np.full(len(keys), -1, np.int32)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero(~hit & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], at[on]
        return out


class _Memory:
    """Growing hash table from keys (of one or more 64-bit integers each, given as arrays) to non-negative integers; -1 for those it lacks."""

    def __init__(self, parts: int = 1, bits: int = 12) -> None:
        self.bits, self.count = bits, 0
        self.keys = [np.zeros(1 << bits, np.uint64) for _ in range(parts)]
        self.values = np.full(1 << bits, -1, np.int32)

    def _home(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k in keys[1:]:
            h = (h ^ h >> np.uint64(29) ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).view(np.int64)

    def _same(self, at: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        same = self.keys[0][at] == keys[0]
        for held, k in zip(self.keys[1:], keys[1:], strict=True):
            same &= held[at] == k
        return same

    def get(self, *keys: np.ndarray) -> np.ndarray:
        at = self._home([*keys])
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & ~self._same(at, [*keys]))
        at = at[left]
        while len(left):
            at = at + 1 & len(self.values) - 1
            out[left] = found = self.values[at]
            on = (found >= 0) & ~self._same(at, [k[left] for k in keys])
            left, at = left[on], at[on]
        return out

    def put(self, values: np.ndarray, *keys: np.ndarray) -> None:
        """Add keys that it lacks, each once, with values that no other key has."""
        self.count += len(values)
        if 2 * self.count > len(self.values):
            held = np.flatnonzero(self.values >= 0)
            old, olds = self.values[held], [k[held] for k in self.keys]
            self.__init__(len(keys), (2 * self.count).bit_length())
            self.put(old, *olds)
            self.count += len(values)
        left, at = np.arange(len(values)), self._home([*keys])
        while len(left):
            free = self.values[at] < 0
            self.values[at[free]] = values[left[free]]
            won = self.values[at] == values[left]
            for held, k in zip(self.keys, keys, strict=True):
                held[at[won]] = k[left[won]]
            left, at = left[~won], at[~won] + 1 & len(self.values) - 1


class _Rows:
    """A growing array."""

    def __init__(self, dtype: type) -> None:
        self.held, self.n = np.zeros(1024, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            held = np.zeros(2 * (self.n + len(values)), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordBpe:
    """A tokenizer file of the kind: NFC, white space, lower case; words; byte-level BPE with a mark on word ends.

    Symbols are bytes, plus 256 for the last byte of a word. The vocabulary is kept as arrays alone, as each worker holds
    its own: of the mappings that they are made from nothing is left after loading.
    """

    def __init__(self, path: str, decoding: bool = True) -> None:
        self.decoding = decoding
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()

        def symbols(token: str) -> tuple[int, ...] | None:
            ends = token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if ends else token
            if not body or any(c not in letters for c in body):
                return None
            codes = [letters[c] for c in body]
            if ends:
                codes[-1] += 256
            return tuple(codes)

        names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        self.named = [names.get(i, "") for i in range(max(names) + 1)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces, self.spaces = regex.compile(pattern), regex.compile(r"\s")
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        ids, merges = model["vocab"], model["merges"]
        del spec, model, names
        parts = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        del merges
        forms = {i: s for t, i in ids.items() if (s := symbols(t))}
        del ids
        self._merges(parts)
        sound = self._sound(forms, parts)
        del parts
        self._automaton({i: forms[i] for i in sound})
        del forms, sound
        self.pairs: dict[int, bool] = {}
        self.met = _Memory()
        self.by_kind = pattern == _BY_KIND
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        self._forget()
        self._forget_prefixes()
        self._forget_words()

    def _merges(self, parts: np.ndarray) -> None:
        """Each token's first merge and its halves, and each pair's last merge, from the rows (left, right, both)."""
        n = len(self.named)
        self.ranks, self.lefts, self.rights = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        made, first = np.unique(parts[:, 2], return_index=True)
        self.ranks[made], self.lefts[made], self.rights[made] = first, parts[first, 0], parts[first, 1]
        pairs, last = np.unique((parts[:, 0] << 17 | parts[:, 1])[::-1], return_index=True)
        self.merges = _Table(pairs, (len(parts) - 1 - last).astype(np.int32))

    def _sound(self, forms: dict[int, tuple[int, ...]], parts: np.ndarray) -> list[int]:
        """Tokens whose own string encodes to them, single symbols first, then by their merges."""
        made = np.unique(parts[:, 2])
        apart = np.zeros(len(self.named), bool)
        apart[made] = self._apart_many(self.lefts[made], self.rights[made], self.ranks[made])
        single = [i for i, s in forms.items() if len(s) == 1]
        sound, out = set(single), sorted(single, key=self.ranks.item)
        for i in made[np.argsort(self.ranks[made], kind="stable")].tolist():
            if i in forms and i not in sound and apart[i] and self.lefts.item(i) in sound and self.rights.item(i) in sound:
                sound.add(i)
                out.append(i)
        return out

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of the adjacent tokens a and b.

        Walks back in time over the tokens that touch at the border: the younger one is undone first, of equally old
        ones the right, as equal merges run from left to right. Touching tokens merge if their merge comes before
        those that use the left one up, and not after those that use the right one up.
        """
        rank, left_used, right_used = self.ranks.item, math.inf, math.inf
        while True:
            r = self.merges.one(a << 17 | b)
            if r >= 0 and r < left_used and r <= right_used:
                return False
            ra, rb = rank(a), rank(b)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                left_used, a = ra, self.rights.item(a)
            else:
                right_used, b = rb, self.lefts.item(b)

    def follows(self, a: int, b: int) -> bool:
        """Pair compatibility: the concatenation of a's and b's strings encodes to (a, b)."""
        key = a << 17 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def _forget(self) -> None:
        """Prefixes met so far, each once: a prefix is (the one without its last symbol) * 512 + that symbol."""
        self.prefix: dict[int, int] = {}
        self.at, self.size, self.last, self.before = [0], [0], [-1], [0]

    def _automaton(self, forms: dict[int, tuple[int, ...]]) -> None:
        """Suffix automaton of all tokens' strings: go[state][symbol], link and longest length of each state, and the tokens that end in it; as arrays."""
        go: list[dict[int, int]] = [{}]
        link, longest = [-1], [0]

        def add(last: int, c: int) -> int:
            known = go[last].get(c)
            if known is not None and longest[known] == longest[last] + 1:
                return known
            if known is None:
                new = len(go)
                go.append({}), link.append(0), longest.append(longest[last] + 1)
                p = last
                while p >= 0 and c not in go[p]:
                    go[p][c] = new
                    p = link[p]
                if p < 0:
                    return new
                q = go[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                    return new
            else:
                new, p, q = -1, last, known
            twin = len(go)
            go.append(dict(go[q])), link.append(link[q]), longest.append(longest[p] + 1)
            while p >= 0 and go[p].get(c) == q:
                go[p][c] = twin
                p = link[p]
            link[q] = twin
            if new < 0:
                return twin
            link[new] = twin
            return new

        for s in forms.values():
            at = 0
            for c in s:
                at = add(at, c)
        here: dict[int, list[tuple[int, int]]] = {}
        for i, s in forms.items():
            at = 0
            for c in s:
                at = go[at][c]
            here.setdefault(at, []).append((len(s), i))
        keys = np.fromiter((state << 9 | c for state, row in enumerate(go) for c in row), np.int64)
        self.step = _Table(keys, np.fromiter((t for row in go for t in row.values()), np.int32))
        go.clear()
        self.links, self.lengths = np.array(link, np.int32), np.array(longest, np.int32)
        # (length, token) of all tokens that are suffixes of the state's longest string, longest first
        ending: list[tuple[tuple[int, int], ...]] = [()] * len(link)
        for state in sorted(range(len(link)), key=longest.__getitem__):
            below = ending[link[state]] if state else ()
            ending[state] = (*sorted(here[state], reverse=True), *below) if state in here else below
        self.first_end = np.cumsum([0, *map(len, ending)]).astype(np.int64)
        self.end_size, self.end_token = (np.fromiter((e[i] for ends in ending for e in ends), np.int32) for i in (0, 1))

    def _extend(self, path: list[int], c: int) -> int:
        """The prefix that follows path[-1] by symbol c: its place in the automaton, last token and back-pointer."""
        state, size, i = self.at[path[-1]], self.size[path[-1]], len(path)
        while (to := self.step.one(state << 9 | c)) < 0:
            if not state:
                raise ValueError(f"the vocabulary lacks symbol {c}")
            state = self.links.item(state)
            size = self.lengths.item(state)
        size += 1
        for k in range(self.first_end.item(to), self.first_end.item(to + 1)):
            n, t = self.end_size.item(k), self.end_token.item(k)
            if n <= size and (n == i or self.follows(self.last[path[i - n]], t)):
                break
        else:
            raise ValueError("no token ends here")
        self.at.append(to), self.size.append(size), self.last.append(t), self.before.append(path[i - n])
        return len(self.at) - 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, along the prefixes known from other words as far as they go."""
        codes = list(word.encode("utf-8"))
        codes[-1] += 256
        if len(self.at) + len(codes) > REMEMBERED:
            self._forget()
        prefix, path, node = self.prefix, [0], 0
        for c in codes:
            key = node << 9 | c
            node = prefix.get(key)
            if node is None:
                node = prefix[key] = self._extend(path, c)
            path.append(node)
        out = []
        while node:
            out.append(self.last[node])
            node = self.before[node]
        out.reverse()
        return out

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """follows() of many pairs; each distinct pair is worked out once."""
        pairs, where = np.unique(a.astype(np.int64) << 17 | b, return_inverse=True)
        a, b = (pairs >> 17).astype(np.int32), (pairs & 0x1FFFF).astype(np.int32)
        return self._apart_many(a, b, np.full(len(pairs), 2**31 - 1, np.int32))[where]

    def _apart_many(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """_apart() of many pairs, for merges before ``until``."""
        good = np.ones(len(a), bool)
        rows = np.arange(len(a))
        left_used = right_used = until
        while len(rows):
            r = self.merges.get(a.astype(np.int64) << 17 | b)
            crossed = (r >= 0) & (r < left_used) & (r <= right_used) & (r < until[rows])
            good[rows[crossed]] = False
            ra, rb = self.ranks[a], self.ranks[b]
            keep = ~crossed & ((ra >= 0) | (rb >= 0))
            rows, a, b, ra, rb, left_used, right_used = (x[keep] for x in (rows, a, b, ra, rb, left_used, right_used))
            younger = ra > rb
            left_used, right_used = np.where(younger, ra, left_used), np.where(younger, right_used, rb)
            a, b = np.where(younger, self.rights[a], a), np.where(younger, b, self.lefts[b])
        return good

    def _forget_prefixes(self) -> None:
        """As _forget(), for words that are worked on together. Of each prefix its number of tokens as well."""
        self.nodes = _Memory()
        self.states, self.reached, self.lasts, self.befores, self.counts = (_Rows(np.int32) for _ in range(5))
        for rows, root in ((self.states, 0), (self.reached, 0), (self.lasts, -1), (self.befores, 0), (self.counts, 0)):
            rows.add(np.array([root]))

    def _new_prefixes(self, keys: np.ndarray, path: np.ndarray, words: np.ndarray) -> np.ndarray:
        """_extend() of many prefixes: path[k, words] are those of k symbols on the way to each key's."""
        i, above, c = len(path), keys >> 9, keys & 511
        state, size = self.states.held[above], self.reached.held[above]
        to = self.step.get(state.astype(np.int64) << 9 | c)
        lost = np.flatnonzero(to < 0)
        while len(lost):
            if not state[lost].all():
                raise ValueError("the vocabulary lacks a symbol")
            state[lost] = self.links[state[lost]]
            size[lost] = self.lengths[state[lost]]
            to[lost] = self.step.get(state[lost].astype(np.int64) << 9 | c[lost])
            lost = lost[to[lost] < 0]
        size += 1
        last, before = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
        rows, at = np.arange(len(keys)), self.first_end[to]
        while len(rows):
            k, t = self.end_size[at], self.end_token[at]
            good = k <= size[rows]
            from_ = path[np.maximum(i - k, 0), words[rows]]
            ask = np.flatnonzero(good & (k < i))
            if len(ask):
                good[ask] = self._may_follow(self.lasts.held[from_[ask]], t[ask])
            done = rows[good]
            last[done], before[done] = t[good], from_[good]
            rows, at = rows[~good], at[~good] + 1
        new = np.arange(self.states.n, self.states.n + len(keys), dtype=np.int32)
        self.nodes.put(new, keys.view(np.uint64))
        for held, values in ((self.states, to), (self.reached, size), (self.lasts, last), (self.befores, before), (self.counts, self.counts.held[before] + 1)):
            held.add(values)
        return new

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """follows() of many pairs, with a memory of those met."""
        keys = a.astype(np.uint64) << np.uint64(17) | b.astype(np.uint64)
        out = self.met.get(keys)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first, where = np.unique(keys[miss], return_index=True, return_inverse=True)
            good = self._follow(a[miss[first]], b[miss[first]])
            if self.met.count + len(new) > REMEMBERED:
                self.met = _Memory()
            # values tell keys apart in the table: twice the key's number, and whether it is good
            self.met.put(2 * np.arange(self.met.count, self.met.count + len(new), dtype=np.int32) + good, new)
            out[miss] = good[where]
        return out % 2 == 1

    def _encode_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words data[start : start + size] one after the other, and each word's number of them.

        encode_word()'s steps, taken place by place for all words together.
        """
        if len(start) > TOGETHER:
            parts = [self._encode_words(data, start[k : k + TOGETHER], size[k : k + TOGETHER]) for k in range(0, len(start), TOGETHER)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])
        if self.nodes.count > PREFIXES:
            self._forget_prefixes()
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        width = int(size[0]) if len(size) else 0
        reach = np.searchsorted(-size, -np.arange(width + 2), "right")  # words of at least so many bytes
        path = np.zeros((width + 1, len(size)), np.int32)
        for i in range(1, width + 1):
            n = reach[i]
            c = data[start[:n] + (i - 1)].astype(np.int64)
            c[reach[i + 1] : n] += 256
            key = path[i - 1, :n].astype(np.int64) << 9 | c
            node = self.nodes.get(key.view(np.uint64))
            miss = np.flatnonzero(node < 0)
            if len(miss):
                new, first, where = np.unique(key[miss], return_index=True, return_inverse=True)
                node[miss] = self._new_prefixes(new, path[:i], miss[first])[where]
            path[i, :n] = node
        node = np.empty(len(size), np.int32)
        node[order] = path[size, np.arange(len(size))]
        count = self.counts.held[node]
        at = np.cumsum(count, dtype=np.int64) - 1
        out = np.empty(int(at[-1]) + 1 if len(at) else 0, np.int32)
        while len(node):
            out[at] = self.lasts.held[node]
            node = self.befores.held[node]
            left = np.flatnonzero(node)
            node, at = node[left], at[left] - 1
        return out, count

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """encode_word() of many words."""
        coded = [w.encode("utf-8") for w in words]
        size = np.array([len(c) for c in coded], np.int64)
        short = np.flatnonzero(size <= LONG_WORD)
        ids, count = self._encode_words(np.frombuffer(b"".join(coded), np.uint8), (np.cumsum(size) - size)[short], size[short])
        found = dict(zip(short.tolist(), np.split(ids, np.cumsum(count)[:-1]), strict=True)) if len(short) else {}
        return [found[i].tolist() if i in found else self.encode_word(w) for i, w in enumerate(words)]

    def normalise(self, text: str) -> str:
        """NFC and lower case, letter by letter: a final sigma is not special."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        codes = codes[codes >= _NEW[0]]
        return (text.translate(_NEW_CAPITALS) if len(codes) and np.isin(codes, _NEW).any() else text).lower()

    def _forget_words(self) -> None:
        """Words met so far: short ones by their bytes and size, others by their bytes; of each the place and number of its ids."""
        self.short, self.others = _Memory(2), {}
        self.ids, self.id_at, self.id_count = _Rows(np.int32), _Rows(np.int64), _Rows(np.int64)

    def _learn(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Remember words' ids; gives the words' numbers."""
        new = np.arange(self.id_at.n, self.id_at.n + len(count), dtype=np.int32)
        self.id_at.add(self.ids.n + np.cumsum(count) - count)
        self.id_count.add(count)
        self.ids.add(ids)
        return new

    def _kinds_of(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.uint8)
        for at in range(0, len(codes), TOGETHER):  # an index takes eight bytes for each character
            part = codes[at : at + TOGETHER]
            kinds = self.kinds[part]
            if (kinds == _UNKNOWN).any():
                for c in np.unique(part[kinds == _UNKNOWN]).tolist():
                    self.kinds[c] = next(kind for kind, p in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SIGN, r"(?s:.)")) if regex.match(p, chr(c)))
                kinds = self.kinds[part]
            out[at : at + TOGETHER] = kinds
        return out

    def _words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last places of all words of a normalised text that begins and ends with white space."""
        if not self.by_kind:
            spans = [m.span() for m in self.pieces.finditer(codes.astype("<u4").tobytes().decode("utf-32-le"))]
            return tuple(np.array(spans, np.int64).reshape(-1, 2).T)
        kinds = self._kinds_of(codes)
        begins = np.zeros(len(codes), bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
        # 's and its like, where no sign stands before: what the pattern tries first, so the rest of the letters is a word of its own
        at = np.flatnonzero(codes[:-2] == 39)
        at = at[begins[at]]
        a, b = codes[at + 1], codes[at + 2]
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
        begins[at[one | two] + 1] = False
        begins[at[one] + 2] = True
        begins[at[two] + 3] = True
        borders = np.flatnonzero(begins)
        words = np.flatnonzero(kinds[borders] != _SPACE)
        return borders[words], borders[words + 1]

    def _numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each word data[start : start + size]; those not met before are encoded. Sixteen bytes follow the last word."""
        out = np.empty(len(start), np.int32)
        rest = np.flatnonzero(size > SHORT_WORD)
        short = np.flatnonzero(size <= SHORT_WORD) if len(rest) else slice(None)
        at, n = start[short], size[short]
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        keys = eight[at] & _FIRST[n], eight[at + 8] & _SECOND[n] | n.astype(np.uint64) << np.uint64(56)
        found = self.short.get(*keys)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            a, b = (k[miss] for k in keys)
            order = np.lexsort((a, b))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            first = miss[order[new]]
            numbers = self._learn(*self._encode_words(data, at[first], n[first]))
            self.short.put(numbers, a[new], b[new])
            found[miss[order]] = numbers[np.cumsum(new) - 1]
        out[short] = found
        if len(rest):
            words = [data[p : p + k].tobytes() for p, k in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
            new = list(dict.fromkeys(w for w in words if w not in self.others))
            ids = self.encode_words([w.decode("utf-8") for w in new])
            self.others |= zip(new, self._learn(np.array([i for row in ids for i in row], np.int32), np.array([len(row) for row in ids], np.int64)).tolist(), strict=True)
            out[rest] = [self.others[w] for w in words]
        return out

    def _spans(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised texts as bytes, the first byte and size of each word, and the number of each text's first word."""
        joined = " " + "  ".join(texts) + "  "
        data = joined.encode("utf-8")
        if len(data) == len(joined):
            start, past = self._words(np.frombuffer(data, np.uint8))
        else:
            start, past = self._words(np.frombuffer(joined.encode("utf-32-le"), "<u4"))
        first = np.searchsorted(start, np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1])
        if len(data) != len(joined):
            place = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            start, past = place[start], place[past]
        return data, start, past - start, first

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts. Those of ASCII alone, where each character is a byte, are split apart from the others."""
        order = sorted(range(len(texts)), key=lambda i: not texts[i].isascii())
        n = sum(t.isascii() for t in texts)
        a, b = self._spans([texts[i] for i in order[:n]]), self._spans([texts[i] for i in order[n:]])
        data = np.frombuffer(a[0] + b[0] + b"\0" * 16, np.uint8)
        first = np.concatenate([a[3], b[3] + len(a[1])])
        start, size = np.concatenate([a[1], b[1] + len(a[0])]), np.concatenate([a[2], b[2]])
        del a, b
        if self.short.count + len(self.others) > WORDS:
            self._forget_words()
        words = self._numbers(data, start, size)
        del data, start, size
        count = self.id_count.held[words]
        before = np.r_[0, np.cumsum(count)]
        at = np.repeat(self.id_at.held[words] - before[:-1], count)
        at += np.arange(len(at))
        ids = self.ids.held[at].astype("<u4", copy=False)
        bounds = before[np.r_[first, len(words)]].tolist()
        out = [ids] * len(texts)
        for i, a, b in zip(order, bounds, bounds[1:]):
            out[i] = ids[a:b]
        return out

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, int, str]]:
        """Whole texts' ids as little-endian 32-bit integers, their number, and their decoded forms (empty without decoding)."""
        done = []
        at = 0
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) < AT_ONCE:
                n += len(texts[end])
                end += 1
            done += self._some(texts[at:end]) if n <= AT_ONCE else [self._long(texts[at])]
            at = end
        return done

    def _long(self, text: str) -> tuple[bytes, int, str]:
        """A text that is encoded part by part: no word goes beyond white space."""
        data, decoded, at = [], [], 0
        while at < len(text):
            space = self.spaces.search(text, at + AT_ONCE)
            end = space.start() if space else len(text)
            ((ids, _, back),) = self._some([text[at:end]])
            data.append(ids)
            if back:
                decoded.append(back)
            at = end
        data = b"".join(data)
        return data, len(data) // 4, " ".join(decoded)

    def _some(self, texts: list[str]) -> list[tuple[bytes, int, str]]:
        parts = [self.marks.split(t) if self.marks and "<|" in t else [t] for t in texts]  # every second one is a special token
        flat = [self.normalise(p) for row in parts for p in row[::2]]
        out, at = [], iter(self._texts(flat))
        for row in parts:
            found = next(at)
            if len(row) > 1:
                found = np.concatenate([found, *(x for mark in row[1::2] for x in (np.array([self.special[mark]], "<u4"), next(at)))])
            out.append((found.tobytes(), len(found), " ".join(map(self.named.__getitem__, found.tolist())) if self.decoding else ""))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_decode([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as the file names no decoder."""
        return " ".join(self.named[i] for i in ids)


@lru_cache(2)
def load(path: str, decoding: bool = True) -> WordBpe:
    return WordBpe(path, decoding)


remembers(load.cache_clear)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256); ids and decoded only on demand.

    Null texts count as empty: no ids and the digests of nothing. Rows that repeat are encoded each. The vocabulary
    file is read at ``path`` on each executor.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, ids, texts, di, dt = [], [], [], [], []
            for data, count, decoded in bpe.encode_decode([t or "" for t in b.column(1).to_pylist()]):
                n.append(count)
                di.append(hashlib.sha256(data).hexdigest())
                dt.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(data, "<u4").astype(np.int32))
                    texts.append(decoded)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(di), pa.array(dt)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)
