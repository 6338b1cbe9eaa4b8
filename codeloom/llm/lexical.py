"""Ranked lexical search over an inverted index of fixed-size compressed posting blocks, by Block-Max WAND.

The index is cut into shards of documents; a task builds a shard from the documents that it reads, without a shuffle.
A term's postings in a shard lie in blocks of BLOCK; each is a row with its first and last document, its postings as
variable-length gaps and frequencies, and the pairs (frequency, document length) that none of its other postings
exceeds in both, so that its greatest impact is known exactly for any corpus statistics before it is decompressed.

A search reads only its terms' blocks. In each shard a query's block borders cut the documents into windows; a
window's bound is the sum of the greatest impacts of the blocks over it. These shallow moves need the blocks' borders
alone; they are taken for all windows of a query at once. Windows with the largest bounds are opened first; as the
k-th score rises, windows whose bound is below it are skipped, and blocks under skipped windows only are never
decompressed. A window whose bound equals the k-th score is opened, as ties go to smaller doc_ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import BROADCAST_ROWS, discard, give_back, prepare, stage_table
from codeloom.llm.words import mix

#: Postings in a block.
BLOCK = 128
#: Bytes of text, and documents, that make a shard; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 65_536
#: Bytes whose terms are found together, but for longer terms.
SLICE = 1 << 20
#: Terms of queries that are searched in one pass over the index; further queries take further passes.
PASS_TERMS = BROADCAST_ROWS // 2
#: Windows that are opened first; four times as many in each further step.
OPENED = 16
#: The maximal runs of these characters are terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
_BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the terms of ``data``, lower-cased UTF-8."""
    starts, ends, hashes, at = [], [], [], 0
    whole = np.frombuffer(data, np.uint8)
    while at < len(whole):
        to = min(at + SLICE, len(whole))
        while to < len(whole) and _IN_TERM[whole[to]]:
            more = np.flatnonzero(~_IN_TERM[whole[to : to + SLICE]])
            to = to + int(more[0]) if len(more) else min(to + SLICE, len(whole))
        part = whole[at:to]
        inside = np.concatenate(([False], _IN_TERM[part], [False]))
        change = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = change[::2], change[1::2]
        up, down = _power_table(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at), ends.append(e + at)
        at = to
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers in 7 bits a byte, least first, the highest bit on all but the last byte; and where each begins, with the end."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        low = values[rows] >> 7 * k & 127
        out[at[rows] + k] = np.where(sizes[rows] > k + 1, low | 128, low)
    return out, at


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.empty(0, np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


_SCHEMA = pa.schema([
    ("shard", pa.int64()), ("term", pa.string()), ("n_docs", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("impacts", pa.list_(pa.int32())),
    ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("total", pa.int64()),
])
INDEX = "shard long, term string, n_docs int, first int, last int, impacts array<int>, data binary, doc_ids array<long>, sizes array<int>, total long"


def _shard(number: int, rows: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: first its documents (term null), then its blocks. Documents are numbered by doc_id, nulls last."""
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    data = b"\n".join(t for _, t in rows).lower()
    begins = np.cumsum([0, *[len(t) + 1 for _, t in rows]])
    starts, ends, hashes = terms_of(data)
    doc = (np.searchsorted(begins, starts, "right") - 1).astype(np.int32)
    size = np.bincount(doc, minlength=len(rows)).astype(np.int32)
    none = pa.nulls
    yield pa.RecordBatch.from_arrays([
        pa.array([number]), none(1, pa.string()), pa.array([int((size > 0).sum())], pa.int32()), none(1, pa.int32()), none(1, pa.int32()), none(1, pa.list_(pa.int32())), none(1, pa.binary()),
        pa.array([[d for d, _ in rows]], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int32())), pa.array([int(size.sum())]),
    ], schema=_SCHEMA)
    if not len(starts):
        return
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    new_term = np.concatenate(([True], h[1:] != h[:-1]))
    new = np.flatnonzero(new_term | np.concatenate(([True], d[1:] != d[:-1])))  # one for each posting
    tf = np.diff(np.append(new, len(h)))
    d, firsts, samples = d[new].astype(np.int64), np.flatnonzero(new_term[new]), order[new[new_term[new]]]
    del h, order, hashes, doc
    counts = np.diff(np.append(firsts, len(d)))
    n_blocks = -(-counts // BLOCK)
    in_term = np.arange(int(n_blocks.sum())) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    block = np.repeat(firsts, n_blocks) + in_term * BLOCK  # where each block begins
    past = np.minimum(block + BLOCK, np.repeat(firsts + counts, n_blocks))
    length = past - block
    gaps = np.diff(d, prepend=0)
    gaps[block] = 0
    both = np.empty(2 * len(d), np.int64)
    both[::2], both[1::2] = gaps, tf
    packed, at = pack_numbers(both)
    at = np.append(at[2 * block], at[-1])
    # pairs no other posting of the block exceeds: by falling frequency, then rising length, those shorter than all before
    of, n = np.repeat(np.arange(len(block)), length), size[d].astype(np.int64)
    by = np.lexsort((n, -tf, of))
    span = int(n.max()) + 1
    coded = n[by] - of[by] * span
    least = np.minimum.accumulate(coded)
    keep = by[np.concatenate(([True], coded[1:] < least[:-1]))]
    pairs = np.empty(2 * len(keep), np.int32)
    pairs[::2], pairs[1::2] = tf[keep], n[keep]
    pair_at = np.concatenate(([0], 2 * np.cumsum(np.bincount(of[keep], minlength=len(block)))))
    # the terms' texts, of a first occurrence each
    s, width = starts[samples], ends[samples] - starts[samples]
    text_at = np.concatenate(([0], np.cumsum(width)))
    letters = np.frombuffer(data, np.uint8)[np.arange(text_at[-1]) + np.repeat(s - text_at[:-1], width)]
    texts = pa.StringArray.from_buffers(len(s), pa.py_buffer(text_at.astype(np.int32)), pa.py_buffer(letters))
    rows_of = len(block)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(rows_of, number)), texts.take(pa.array(np.repeat(np.arange(len(s)), n_blocks))), pa.array(length.astype(np.int32)), pa.array(d[block].astype(np.int32)), pa.array(d[past - 1].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(pair_at.astype(np.int32)), pa.array(pairs)), pa.BinaryArray.from_buffers(pa.binary(), rows_of, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(packed)]),
        none(rows_of, pa.list_(pa.int64())), none(rows_of, pa.list_(pa.int32())), none(rows_of, pa.int64()),
    ], schema=_SCHEMA)


def build_index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the index, a table in the shared folder: a row for each shard's documents (term null) and each block.

    Null texts have no terms. Rows that repeat a doc_id, or have none, are documents of their own. Terms are told apart
    by 64-bit hashes inside a shard, by their texts between shards.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body = (text or "").encode("utf-8", "surrogatepass")
                if rows and (held + len(body) > SHARD_BYTES or len(rows) >= SHARD_DOCS):
                    yield from _shard(number, rows)
                    number, rows, held = number + 1, [], 0
                rows.append((doc, body))
                held += len(body)
        if rows:
            yield from _shard(number, rows)
        give_back()

    return stage_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "lexical")


class Shard:
    """One shard's blocks of the terms that are asked for."""

    def __init__(self, table: pa.Table, n_docs: int, total: int, weights: dict[str, int]) -> None:
        table = table.combine_chunks()
        is_doc = np.asarray(table["term"].is_null())
        docs = table.filter(pa.array(is_doc)).slice(0, 1)
        blocks = table.filter(pa.array(~is_doc)).sort_by([("term", "ascending"), ("first", "ascending")]).combine_chunks()
        self.doc_ids = docs["doc_ids"][0].as_py() if len(docs) else []
        size = np.array(docs["sizes"][0].as_py() if len(docs) else [], np.int64)
        self.norm = 100 - 90 + (90 * size * n_docs) // max(1, total)
        terms = blocks["term"].to_pylist()
        self.of: dict[str, tuple[int, int]] = {}
        for i, t in enumerate(terms):
            self.of[t] = (self.of[t][0] if t in self.of else i, i + 1)
        self.weight = np.array([weights[t] for t in terms], np.int64)
        self.first, self.last = (np.asarray(blocks[c], np.int64) for c in ("first", "last"))
        whole = blocks["impacts"].combine_chunks()
        pairs = np.asarray(whole.flatten(), np.int64)
        m = 100 - 90 + (90 * pairs[1::2] * n_docs) // max(1, total)
        sizes = np.asarray(whole.value_lengths(), np.int64)
        begins = (np.cumsum(sizes) - sizes) // 2
        best = np.maximum.reduceat(impact(pairs[::2], m), begins) if len(terms) else np.empty(0, np.int64)
        self.bound = self.weight * best
        self.data = [np.frombuffer(v, np.uint8) for v in blocks["data"].to_pylist()]
        self.docs: list[np.ndarray | None] = [None] * len(terms)
        self.scores: list[np.ndarray | None] = [None] * len(terms)

    def open(self, blocks: np.ndarray) -> None:
        """Decompress those of ``blocks`` that aren't yet."""
        shut = [i for i in blocks.tolist() if self.docs[i] is None]
        if not shut:
            return
        numbers = unpack_numbers(np.concatenate([self.data[i] for i in shut]))
        gap, tf = numbers[::2], numbers[1::2]
        counts = np.array([int((self.data[i] < 128).sum()) // 2 for i in shut])
        begins = np.cumsum(counts) - counts
        run = np.cumsum(gap)
        doc = run - np.repeat(run[begins] - self.first[shut], counts)
        score = impact(tf, self.norm[doc]) * np.repeat(self.weight[shut], counts)
        for i, at, n in zip(shut, begins.tolist(), counts.tolist(), strict=True):
            self.docs[i], self.scores[i] = doc[at : at + n], score[at : at + n]

    def top(self, terms: list[str], k: int) -> list[tuple[int, int]]:
        """(score, document's number) of the k best documents with a score above 0; equal scores by number."""
        ranges = [self.of[t] for t in terms if t in self.of]
        if not ranges:
            return []
        mine = np.concatenate([np.arange(a, b) for a, b in ranges])
        first, past, bound = self.first[mine], self.last[mine] + 1, self.bound[mine]
        borders = np.unique(np.concatenate((first, past)))
        change = np.bincount(np.searchsorted(borders, first), bound, len(borders)) - np.bincount(np.searchsorted(borders, past), bound, len(borders))
        bounds = np.cumsum(change)[:-1]  # of the window from each border to the next; whole numbers below 2^53, so exact
        order = np.argsort(-bounds, kind="stable")
        found: list[tuple[int, int]] = []
        least, at, step = 1, 0, OPENED
        while at < len(order) and bounds[order[at]] >= least:
            chosen = order[at : at + step]
            chosen = chosen[bounds[chosen] >= least]
            at, step = at + step, 4 * step
            # blocks over a chosen window
            count = np.concatenate(([0], np.cumsum(np.bincount(chosen, minlength=len(borders)))))
            over = mine[count[np.searchsorted(borders, past)] > count[np.searchsorted(borders, first)]]
            self.open(over)
            doc = np.concatenate([self.docs[i] for i in over])
            total = np.bincount(doc, np.concatenate([self.scores[i] for i in over]), len(self.norm))
            inside = np.zeros(len(self.norm) + 1, np.int32)
            np.add.at(inside, borders[chosen], 1)
            np.add.at(inside, borders[chosen + 1], -1)
            good = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (total >= least))
            if len(good) > k:
                good = good[np.lexsort((good, -total[good]))[:k]]
            found = sorted([*found, *zip((-total[good]).astype(np.int64).tolist(), good.tolist(), strict=True)])[:k]
            if len(found) == k:
                least = max(1, -found[-1][0])
        return [(-s, d) for s, d in found]


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's impact before its term's weight: rises with the frequency, falls with the document's norm m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """index, (item_id, text) -> (item_id, rank, doc_id, score), the k documents of each item with the highest scores above 0.

    A document's score is the sum over the item's distinct terms of weight * impact, in whole numbers; equal scores are
    ranked by doc_id, null last. Items without terms, or whose terms no document has, give no rows. Rows of items that
    repeat an item_id are items of their own. Queries are searched PASS_TERMS terms at a time, so what is sent to tasks is bounded.
    """
    spark = index.sparkSession
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))
    asked = stage_table(items.select("item_id", words.alias("terms")).where("size(terms) > 0").withColumn("query", F.monotonically_increasing_id()), "asked")
    n_docs, total = index.where("term is null").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = asked.groupBy(F.shiftright("query", 33).alias("part")).agg(F.sum(F.size("terms")).alias("n"))  # one row for each file of the table
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("query").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = asked.withColumn("part", F.shiftright("query", 33)).withColumn("sum", F.sum(F.size("terms")).over(within)).join(F.broadcast(parts), "part")
    numbered = stage_table(numbered.select("item_id", "query", "terms", F.floor((F.col("start") + F.col("sum")) / PASS_TERMS).alias("turn")), "queries")
    passes = [r[0] for r in numbered.select("turn").distinct().orderBy("turn").collect()]
    found = None
    for turn in passes:
        one = stage_table(_pass(index, numbered.where(F.col("turn") == turn), k, n_docs, total), "found")
        found = one if found is None else found.unionByName(one)
    discard(asked)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _pass(index: DataFrame, queries: DataFrame, k: int, n_docs: int, total: int) -> DataFrame:
    """(query, doc_id, score): the k best documents of each shard."""
    spark = index.sparkSession
    terms = stage_table(queries.select(F.explode("terms").alias("term")).distinct(), "terms")
    blocks = index.where("term is not null").join(F.broadcast(terms), "term", "left_semi")
    df = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}  # PASS_TERMS at most
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = [(r["query"], [t for t in r["terms"] if weights.get(t)]) for r in queries.select("query", "terms").collect()]  # the same terms
    shared = spark.sparkContext.broadcast((weights, [a for a in asked if a[1]]))

    def run(table: pa.Table) -> pa.Table:
        weights, asked = shared.value
        shard = Shard(table, n_docs, total, weights)
        out = [(q, shard.doc_ids[d], s) for q, terms in asked for s, d in shard.top(terms, k)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    wanted = blocks.unionByName(index.where("term is null")).drop("total")
    return wanted.groupBy("shard").applyInArrow(run, "query long, doc_id long, score long")
