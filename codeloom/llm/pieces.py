"""Exact encoding and decoding with a byte-pair piece model, keeping each piece's place in the original text.

A text is normalised by the model's compiled character map: at each place the longest key of the map's double-array trie
that the rest begins with is replaced, and without one a character stands for itself. Each normalised byte records the
original byte that it comes from. Spaces become the mark U+2581 and one mark is put in front, as the model says. Pieces
are merged best score first, of equal ones the leftmost, in many runs at once; a piece's place is its first and last
normalised byte taken back to original bytes. Characters that no piece has are written as byte pieces.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import _Table
from codeloom.llm.common import give_back, prepare, remembers

MARK = "▁"
#: What makes a word where runs are cut.
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: Runs remembered by each worker, at most (some 300 bytes each).
RUNS = 500_000
#: Runs that are encoded together; those of more characters are encoded one by one.
TOGETHER, LONG_RUN = 16_384, 48
#: Characters of text that are encoded together, but for longer single texts.
AT_ONCE = 1_000_000
# Piece types of the model format.
_NORMAL, _UNKNOWN, _CONTROL, _OWN, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message: varints as ints, 32-bit and delimited values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys whose values are offsets of zero-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.found: dict[int, bytes] = {}
        starts = [b for b in range(1, 256) if self._step(self._child(0), b)] if self.units else []
        #: bytes that begin no key, in long runs
        self.plain = re.compile(b"[^" + b"".join(b"\\x%02x" % b for b in starts) + b"]+" if starts else rb"(?s:.+)")

    def _child(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, base: int, byte: int) -> int:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else 0

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that ``data`` has at ``at``."""
        node, best, base = 0, None, self._child(0)
        for i in range(at, len(data)):
            node = self._step(base, data[i])
            if not node:
                break
            base = self._child(node)
            if self.units[node] >> 8 & 1:
                best = (i + 1 - at, self.units[base] & 0x7FFFFFFF)
        if best is None:
            return None
        size, place = best
        if place not in self.found:
            self.found[place] = self.texts[place : self.texts.index(b"\0", place)]
        return size, self.found[place]

    def parts(self, data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
        """(start, end, replacement) in order; None for stretches of characters that stand for themselves."""
        at = 0
        while at < len(data):
            m = self.plain.match(data, at)
            to = m.end() if m else at
            while to < len(data) and data[to] & 0xC0 == 0x80 and to > at:  # a key begins with a whole character
                to -= 1
            if to > at:
                yield at, to, None
                at = to
                if at == len(data):
                    return
            if hit := self.longest(data, at):
                yield at, at + hit[0], hit[1]
                at += hit[0]
            else:
                to = at + 1
                while to < len(data) and data[to] & 0xC0 == 0x80:
                    to += 1
                yield at, to, None
                at = to


class Pieces:
    """A model file: pieces with scores and types, normaliser, byte fallback."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = f.read()
        names, scores, types, trainer, normaliser = [], [], [], {}, {}
        for n, v in fields(model):
            if n == 1:
                piece = dict(fields(v))
                names.append(piece.get(1, b"").decode("utf-8"))
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                types.append(piece.get(3, _NORMAL))
            elif n == 2:
                trainer = dict(fields(v))
            elif n == 3:
                normaliser = dict(fields(v))
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or _UNUSED in types or _OWN in types:
            raise ValueError("only byte-pair models with byte fallback and a mark before words are read, without unused or user-defined pieces")
        self.map = CharacterMap(normaliser.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(n, 1)) for n in (3, 4, 5))
        self.names, self.types, self.unknown = names, types, types.index(_UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.bytes = {int(n[1:-1], 16): i for i, (n, t) in enumerate(zip(names, types, strict=True)) if t == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {n: i for i, (n, t) in enumerate(zip(names, types, strict=True)) if t == _NORMAL}
        parts = dict(self.ids)
        for c in sorted({c for n in self.ids for c in n} - self.ids.keys()):  # halves of pieces that are none themselves
            parts[c] = len(names) + len(parts) - len(self.ids)
        self.parts, self.other = parts, len(names) + len(parts) - len(self.ids)
        by_score = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for n, i in self.ids.items():
            for k in range(1, len(n)):
                a, b = parts.get(n[:k]), parts.get(n[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (by_score[scores[i]], i)
        self.pairs = pairs
        self.table = _Table(np.array(list(pairs), np.int64), np.arange(len(pairs), dtype=np.int32))  # no key is 0: that piece is the unknown one
        self.rank, self.joined = (np.array([*(p[i] for p in pairs.values()), 0], np.int64) for i in (0, 1))
        self.rank[-1] = 2**31 - 1
        self.sizes, self.decimal = [len(n.encode()) for n in names], [str(i).encode() for i in range(len(names))]
        self.surface = [n.replace(MARK, " ") if t == _NORMAL else None for n, t in zip(names, types, strict=True)]
        if any(MARK in n.lstrip(MARK) for n in self.ids) or max(self.sizes) > 255:
            raise ValueError("a piece has a mark after another character, or is too long")
        single = {"\n", "\t", "\r"} - {c for n in self.ids if len(n) > 1 for c in n}
        alone = "".join(map(re.escape, sorted(single)))
        apart = {c for n in self.ids for c in n if not c.isalnum() and c not in "_" + MARK} - single
        apart -= {b for n in self.ids for a, b in zip(n, n[1:], strict=False) if re.match(LETTER, a)}
        apart = "".join(map(re.escape, sorted(c for c in apart if not re.match(LETTER, c))))
        #: runs that no piece crosses: marks and a word before a sign that follows no word in a piece, marks and what
        #: follows up to the next mark, and characters that are in no longer piece
        self.runs = re.compile(f"{MARK}*+{LETTER}++(?=[{apart}])|" * bool(apart) + f"{MARK}*+[^{MARK}{alone}]++|{MARK}++" + f"|[{alone}]++" * bool(alone))
        self.known: dict[str, tuple[bytes, bytes, str]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the original byte (UTF-8) where it begins."""
        data = text.encode("utf-8")
        space = MARK.encode() if self.escape else b" "
        out: list[bytes] = []
        places: list[np.ndarray] = []

        def put(piece: bytes, source: np.ndarray) -> None:
            if self.escape and b" " in piece:
                wide = np.where(np.frombuffer(piece, np.uint8) == 32, len(space), 1)
                piece, source = piece.replace(b" ", space), np.repeat(source, wide)
            out.append(piece)
            places.append(source)

        whole = [(0, len(data), None)] if not self.map.units else self.map.parts(data)
        if not self.squeeze:
            if data and self.prefix:
                put(b" ", np.zeros(1, np.int64))
            for a, b, new in whole:
                put(data[a:b], np.arange(a, b)) if new is None else put(new, np.full(len(new), a))
            end = len(data)
        else:  # white space is taken off both ends and single elsewhere; a space's place is that of the run's first
            flat, source, front, leading = [], [], 0, True
            for a, b, new in whole:
                piece = data[a:b] if new is None else new
                flat.append(piece)
                source.append(np.arange(a, b) if new is None else np.full(len(new), a))
                if leading:  # the mark in front stands where leading spaces end
                    blanks = len(piece) - len(piece.lstrip(b" "))
                    front = a + blanks if new is None else b if new == b" " else a
                    leading = piece == b" " * blanks and (new is None or new == b" ")
            joined = b"".join(flat)
            at = np.concatenate(source) if source else np.empty(0, np.int64)
            blank = np.frombuffer(joined, np.uint8) == 32
            left = np.flatnonzero(~(blank & np.concatenate(([True], blank[:-1]))))
            end = len(data) if len(left) else 0
            if len(left):
                if self.prefix:
                    put(b" ", np.array([front]))
                put(np.frombuffer(joined, np.uint8)[left].tobytes(), at[left])
            whole, at = b"".join(out), np.concatenate(places) if places else at
            short = whole
            while short.endswith(space):
                short = short[: -len(space)]
            if len(short) < len(whole):
                end = int(at[len(short)])
            out, places = [short], [at[: len(short)]]
        places.append(np.array([end]))
        return b"".join(out).decode("utf-8"), np.concatenate(places)

    def _one(self, run: str) -> list[int]:
        """Internal ids of one long run: a queue of pairs by score, then place."""
        ids: list[int | None] = [self.parts.get(c, self.other) for c in run]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        queue: list[tuple[int, int, int, int, int]] = []

        def ask(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (hit := self.pairs.get(ids[a] << 20 | ids[b])):
                heapq.heappush(queue, (hit[0], a, b, ids[a] << 20 | ids[b], hit[1]))

        for i in range(len(ids) - 1):
            ask(i, i + 1)
        while queue:
            _, a, b, pair, new = heapq.heappop(queue)
            if ids[a] is None or ids[b] is None or after[a] != b or ids[a] << 20 | ids[b] != pair:
                continue
            ids[a], ids[b] = new, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            ask(before[a], a)
            ask(a, after[a])
        return [i for i in ids if i is not None]

    def _many(self, runs: list[str]) -> list[list[int]]:
        """Internal ids of runs of about one length: each round merges the best pair of every run that has one."""
        get, width = self.parts.get, max(map(len, runs)) + 1
        grid = np.array([[get(c, self.other) for c in r] + [-1] * (width - len(r)) for r in runs], np.int64)

        def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return self.table.get(np.where((a < 0) | (b < 0), 0, a << 20 | b))  # -1, the last rank, for those that don't merge

        hit = pairs(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(runs), width - 1)
        out: list[list[int]] = [[]] * len(runs)
        active = np.arange(len(runs))
        while True:
            rank = self.rank[hit]
            best = rank.argmin(1)
            more = rank[np.arange(len(active)), best] < self.rank[-1]
            for i, row in zip(active[~more].tolist(), grid[~more].tolist(), strict=True):
                out[i] = row[: row.index(-1)]
            if not more.any():
                return out
            grid, hit, best, active = grid[more], hit[more], best[more], active[more]
            rows, column = np.arange(len(active)), np.arange(grid.shape[1] - 1)
            new = self.joined[hit[rows, best]]
            skip = column + (column > best[:, None])
            grid = np.take_along_axis(grid, skip, 1)
            hit = np.take_along_axis(hit, skip[:, :-1], 1)
            grid[rows, best] = new
            hit[rows, best] = pairs(new, grid[rows, best + 1])
            left = np.flatnonzero(best > 0)
            hit[left, best[left] - 1] = pairs(grid[left, best[left] - 1], new[left])

    def _encode_runs(self, runs: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """(run, ids, bytes that each stands for); of a character in byte pieces the last stands for all."""
        by_length = sorted(runs, key=len)
        short = bisect.bisect_right(by_length, LONG_RUN, key=len)
        for k in range(0, short, TOGETHER):
            part = by_length[k : min(short, k + TOGETHER)]
            for r, ids in zip(part, self._many(part), strict=True):
                yield r, *self._written(r, ids)
        for r in by_length[short:]:
            yield r, *self._written(r, self._one(r))

    def _written(self, run: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Internal ids with characters that no piece has written in bytes."""
        if max(ids) < len(self.names):
            return ids, [self.sizes[i] for i in ids]
        real, sizes, at = [], [], 0
        for i in ids:
            if i < len(self.names):
                real.append(i), sizes.append(self.sizes[i])
                at += len(self.names[i])
            else:
                raw = run[at].encode("utf-8")
                real += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
                at += 1
        return real, sizes

    def _learn(self, runs: list[str]) -> dict[str, tuple[bytes, bytes, str]]:
        """(decimal ids, bytes that each stands for, the ids' text) of runs."""
        decimal, out = self.decimal, {}
        for r, ids, sizes in self._encode_runs(runs):
            text = self._text(ids)
            out[r] = (b",".join([decimal[i] for i in ids]), bytes(sizes), r if text == r else text)
        return out

    def encode(self, texts: list[str], spans: bool = True) -> Iterator[tuple[bytes, int, np.ndarray | None, str]]:
        """For each text its ids in decimal joined by commas, their number, their (begin, end) original bytes, and the ids' text."""
        at = 0
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) < AT_ONCE:
                n += len(texts[end])
                end += 1
            normal = [self.normalise(t) for t in texts[at:end]]
            rows = [self.runs.findall(t) for t, _ in normal]
            wanted = set().union(*rows)
            new = list(wanted.difference(self.known))
            if len(self.known) + len(new) > RUNS:
                self.known = {w: self.known[w] for w in wanted if w in self.known}
            self.known |= self._learn(new)
            known = self.known
            for row, (_, source) in zip(rows, normal, strict=True):
                ids, sizes, text = zip(*map(known.__getitem__, row), strict=True) if row else ((), (), ())
                sizes, text = np.frombuffer(b"".join(sizes), np.uint8), "".join(text)
                place = None
                if spans:
                    past = np.cumsum(sizes, dtype=np.int64)
                    place = np.stack([source[past - sizes], source[past]], 1)
                    place[sizes == 0, 1] = place[sizes == 0, 0]
                yield b",".join(ids), len(sizes), place, text[1:] if (self.prefix or self.squeeze) and row and row[0][0] == MARK else text
            at = end

    def _text(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, runs of byte pieces are UTF-8 whose broken bytes become U+FFFD each."""
        out, raw = [], bytearray()

        surface = [self.surface[i] for i in ids]
        if None not in surface:
            return "".join(surface)

        def flush() -> None:
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode("utf-8"))
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            raw.clear()

        for i in ids:
            if self.types[i] == _BYTE:
                raw.append(self.byte_of[i])
                continue
            if raw:
                flush()
            if self.types[i] == _UNKNOWN:
                out.append(self.unknown_text)
            elif self.types[i] != _CONTROL:
                out.append(self.surface[i])
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: one mark at the start, that of the encoder, is left out; control pieces are nothing."""
        if self.prefix or self.squeeze:
            at = 0
            while at < len(ids) and self.types[ids[at]] == _CONTROL:
                at += 1
            if at < len(ids) and self.types[ids[at]] == _NORMAL and self.names[ids[at]].startswith(MARK):
                return self._text([ids[at]])[1:] + self._text(ids[at + 1 :])
        return self._text(ids)


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


remembers(load.cache_clear)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32), and ids, begins, ends, decoded on demand.

    ids are those of the model file at ``path``, read on each executor, without begin and end ids; begins and ends are the
    original UTF-8 bytes of each piece (of a character in byte pieces the last has them, the others are empty).
    ids_sha256 is of decimal ids joined by commas, decoded_sha256 of the ids' text, spans_crc32 of the (begin, end) pairs
    as little-endian 32-bit integers. Null texts count as empty: no ids. Rows that repeat are encoded each.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for b in batches:
            columns: list[list] = [[] for _ in range(8)]
            for ids, n, place, text in model.encode([t or "" for t in b.column(1).to_pylist()]):
                row = [n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest(), zlib.crc32(place.astype("<u4").tobytes())]
                if with_ids:
                    row += [list(map(int, ids.split(b","))) if n else [], place[:, 0].tolist(), place[:, 1].tolist(), text]
                for c, v in zip(columns, row, strict=False):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.string()]
            count = 8 if with_ids else 4
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "ids", "begins", "ends", "decoded"][:count]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(columns[:count], kinds, strict=False)]], ["doc_id", *names])
        give_back(keep=True)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long" + ", ids array<int>, begins array<int>, ends array<int>, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)
