"""Removal of repeated passages wherever they stand: whole lines, parts of lines, or running over line ends.

Words are runs without white space; characters from U+3000 on are words of half the size. A text is cut at line ends,
sentence ends, words whose hash is the least of thirteen, and every 14 words where there is none of these. Windows run
from each cut to the first cut WINDOW words later or more, and to each end of a line or sentence from the last cut as
many words before it; three consecutive lines that aren't blank are windows too,
of any size. Windows are hashed (128 bits) and counted over
all documents. The first occurrence has the smallest doc_id, then the smallest place; words of later ones go but for
those that overlap the window's own first occurrence, so that each has an equal one at an earlier place. As cuts
follow from the words around them, a passage of over 50 words is found in any surroundings; a few words may stay at
an end that isn't that of a line or sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, give_back, join_back, prepare, stage_table
from codeloom.llm.words import _SPACE, _STEP, _TABLE, mix

LINES = 3
#: Least words of a window that isn't whole lines, longest piece between cuts, and neighbours on each side of a least hash.
WINDOW, PIECE, NEAR = 25, 14, 6
_FACTOR = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_END = np.zeros(256, bool)
_END[list(b".!?")] = True


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(x))
    out[0] = 1
    return np.multiply.accumulate(out)


def split(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes), lines and sizes (2, or 1 for a single character) of the words."""
    data = np.frombuffer(text, np.uint8)
    inner = (data & 0xC0) == 0x80
    lead = data[np.maximum.accumulate(np.where(inner, 0, np.arange(len(data))))] if len(data) else data
    space, alone = _SPACE[data], lead >= 0xE3
    before = np.concatenate(([True], (space | alone)[:-1]))
    starts = np.flatnonzero(~space & ~inner & (before | alone))
    after = np.concatenate(((space | (alone & ~inner))[1:], [True]))
    ends = np.flatnonzero(~space & (after | (alone & np.concatenate((~inner[1:], [True]))))) + 1
    return starts, ends, np.cumsum(data == 10)[starts], np.where(alone[starts], 1, 2)


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, first word and number of words of each window."""
    none = np.empty(0, np.int64)
    starts, ends, lines, sizes = split(text)
    n = len(starts)
    if not n:
        return none, none, none, none
    data = np.frombuffer(text, np.uint8)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    at = np.arange(len(data)) - np.maximum.accumulate(begin)
    at[_SPACE[data]] = 0
    h = mix(np.add.reduceat(_TABLE[data] * _powers(int(_STEP), int(at.max()) + 1)[at], starts))

    first = np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1])))
    cut = np.zeros(n + 1, bool)
    cut[first] = cut[n] = True
    cut[1:] |= _END[data[ends - 1]]
    ends_here = cut.copy()
    least = np.ones(n, bool)
    for k in range(1, min(NEAR, n - 1) + 1):
        least[k:] &= h[k:] < h[:-k]
        least[:-k] &= h[:-k] < h[k:]
    cut[:n] |= least
    since = np.arange(n) - np.maximum.accumulate(np.where(cut[:n], np.arange(n), 0))
    cut[:n] |= since % PIECE == 0
    cuts = np.flatnonzero(cut)
    place = np.concatenate(([0], np.cumsum(sizes)))[cuts]
    to = np.searchsorted(place, place + 2 * WINDOW)
    fore = to < len(cuts)
    back = np.searchsorted(place, place - 2 * WINDOW, "right") - 1
    aft = (back >= 0) & ends_here[cuts]
    pairs = np.unique(np.concatenate((cuts[fore] * (n + 1) + cuts[to[fore]], cuts[back[aft]] * (n + 1) + cuts[aft])))
    s, e, kind = pairs // (n + 1), pairs % (n + 1), np.zeros(len(pairs), np.uint64)
    if len(first) >= LINES:
        s = np.concatenate((s, first[: len(first) - LINES + 1]))
        e = np.concatenate((e, np.append(first[LINES:], n)))
        # hashes of the lines' sizes, so that lines are alike only if they end at the same words
        size = np.diff(np.append(first, n)).astype(np.uint64)
        shape = np.zeros(len(first) - LINES + 1, np.uint64)
        for k in range(LINES):
            shape = mix(shape + size[k : len(first) - LINES + 1 + k] + np.uint64(1))
        kind = np.concatenate((kind, shape))
    out = []
    for factor in _FACTOR:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(factor, n), dtype=np.uint64)))
        out.append(mix(mix((sums[e] - sums[s]) * _powers(pow(factor, -1, 1 << 64), n)[s] + (e - s).astype(np.uint64)) ^ kind).view(np.int64))
        h = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return out[0], out[1], s, e - s


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without words s to e - 1 of each span; lines that lose all their words go with their line ends."""
    starts, ends, lines, _ = split(text)
    gone = np.zeros(len(starts) + 1, np.int64)
    for s, e in spans:
        gone[s] += 1
        gone[e] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    out, begin = [], 0
    bounds = np.searchsorted(lines, np.arange(text.count(b"\n") + 2))
    for i, line in enumerate(text.split(b"\n")):
        a, b = bounds[i], bounds[i + 1]
        lost = gone[a:b]
        if not lost.any():
            out.append(line)
        elif not lost.all():
            next_ = np.append(starts[a + 1 : b], begin + len(line))
            kept = b"".join(text[x:y] for x, y in zip(starts[a:b][~lost], next_[~lost]))
            out.append(text[begin : starts[a]] + (kept.rstrip(b" \t\r\v\f") if lost[-1] else kept))
        begin += len(line) + 1
    return b"\n".join(out)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of the documents that lose words: (s, e) word numbers from 0, e not included."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [windows(t or b"") for t in batch.column(1).to_pylist()]
            a, b, s, n = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(4))
            doc = np.repeat(ids, [len(f[0]) for f in found])
            columns = [pa.array(doc, pa.int64()), pa.array(a), pa.array(b), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))]
            whole = pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "s", "n"])
            for i in range(0, len(doc), 50_000):
                yield whole.slice(i, 50_000)
        give_back()

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    found = stage_table(texts.mapInArrow(run, "doc_id long, a long, b long, s int, n int"), "windows")
    groups = found.groupBy("a", "b").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count("*").alias("c")).where("c > 1")
    groups = stage_table(groups, "repeated")
    marked = join_back(found, groups, ["a", "b"], ["first"], "c", max(1, found.count()), F.struct("doc_id", "s", "n"))
    # only what overlaps the window's own first occurrence stays; all else has an equal at an earlier place
    own = F.when(F.col("first.doc_id") == F.col("doc_id"), F.col("first.s") + F.col("n"))
    lost = marked.where(F.col("first") != F.struct("doc_id", "s")).select("doc_id", F.greatest("s", own).alias("s"), (F.col("s") + F.col("n")).alias("e"))
    spans = stage_table(lost.where("s < e").groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")
    discard(found, groups)
    return spans


def remove_repeated_passages(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages removed from text.

    n_chars, if there is such a column, follows the new text. Null texts stay null; a text that loses all its words
    and has no blank lines becomes empty; by ``drop_emptied`` rows that lose all their words leave, as every word of
    theirs is kept elsewhere, while rows without words from the start stay. Rows without a doc_id are kept as they are and not compared; rows that
    repeat a doc_id are treated alike. Empty input: no rows.
    """
    names = docs.columns
    spans = repeated(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[c for c in names if c != "text"]).alias("row"), "text")
    both = rows.join(spans, F.col("row.doc_id") == F.col("id"), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            column, spans, emptied = b.column(1), b.column(2).to_pylist(), []
            if any(spans):
                texts = column.to_pylist()
                for i, found in enumerate(spans):
                    if found and texts[i] is not None:
                        texts[i] = without(texts[i].encode(), [(x["s"], x["e"]) for x in found]).decode()
                        if drop_emptied and not len(split(texts[i].encode())[0]):
                            emptied.append(i)
                column = pa.array(texts, column.type)
            out = pa.RecordBatch.from_arrays([b.column(0), column], ["row", "text"])
            yield out.take(pa.array(np.setdiff1d(np.arange(len(out)), emptied))) if emptied else out
        give_back()

    out = both.mapInArrow(run, rows.schema)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in names])
