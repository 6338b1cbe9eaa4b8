"""Packing of token sequences by minimum bin slack.

Every document's tokens are cut into full windows and a remainder. How often each length occurs is all that the plan
needs: at most ``window`` numbers. For one sequence after the other, the longest length that is left is taken, and a
subset-sum program on a bitset finds the multiset of left lengths that fills the window closest to its capacity; going
back through the program's bitsets gives the count of each length. The sequence is repeated as often as the counts
allow. Pieces then find their place from their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.bpe import load
from codeloom.llm.common import give_back, prepare, stage_table

#: Pieces that are numbered together, about.
NUMBERED = 200


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, of each no more than its count, whose sum is closest to ``capacity`` from below."""
    reach, mask = 1, (1 << capacity + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of one sequence, number of such sequences), until all lengths are used up."""
    counts = {n: c for n, c in counts.items() if c > 0}
    out = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        one = fill({n: c for n, c in rest.items() if c and n <= window - longest}, window - longest)
        one[longest] = one.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in one.items())
        out.append((one, times))
        for n, k in one.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def cut(docs: DataFrame, path: str, window: int, end: int) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each document's pieces of ``window`` ids and its remainder."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, decoding=False)
        for b in batches:
            rows = []
            for doc, (data, n, _) in zip(b.column(0).to_pylist(), bpe.encode_decode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                data += np.array([end], "<u4").tobytes()
                for start in range(0, n + 1, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            del rows
            give_back(keep=True)  # each batch: what a long text took isn't held beside the next ones

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, window: int = 4096, end: int = 2) -> DataFrame:
    """(doc_id, text) -> one row for each piece, with sequence_id and offset.

    Ids are those of the tokenizer file at ``path`` without special tokens, then ``end``. Each id lies in one piece;
    the pieces of a sequence follow each other from offset 0 without gaps and are at most ``window`` ids. Null and
    empty texts give one piece of the end id. Rows that repeat a doc_id, or have none, are packed as documents of
    their own. Empty input: no rows.
    """
    spark = docs.sparkSession
    pieces = stage_table(cut(docs, path, window, end), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    used, sequence, places = dict.fromkeys(counts, 0), 0, []
    for one, times in plan(counts, window):
        offset = 0
        for n in sorted(one, reverse=True):
            places.append((n, used[n], used[n] + one[n] * times, one[n], sequence, offset))
            used[n] += one[n] * times
            offset += n * one[n]
        sequence += times
    # a sequence uses up a length each time, and holds fewer than 2 * sqrt(window) lengths: the table is bounded by the window
    places = spark.createDataFrame(places, "length long, first long, past long, each long, sequence long, base long")
    shares = spark.createDataFrame([(n, max(1, c // NUMBERED)) for n, c in counts.items()], "length long, shares long")
    rows = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "start"), "shares"))
    sizes = rows.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = stage_table(sizes.select("length", "share", before.alias("before")), "shares")
    number = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "start")) - 1
    rows = rows.withColumn("number", number).join(sizes, ["length", "share"]).withColumn("number", F.col("number") + F.col("before"))
    rows = rows.join(F.broadcast(places), "length").where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("past")))
    turn = F.col("number") - F.col("first")
    return rows.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(turn / F.col("each"))).alias("sequence_id"),
        (F.col("base") + turn % F.col("each") * F.col("length")).alias("offset"),
    )
