"""Quotation linking of messages.

Leading ``>`` signs give each line its quote level. Consecutive lines of one level are a passage; its normalised text
(case and white space folded) is hashed, and so are its lines. Hashes of quoted passages are joined to those of the
conversation's own messages; the message that a first-level passage was first written in is what the quoting one
replies to. Threads are followed to their first message by pointer jumping. Conversations hold the messages without
quotes in reply order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import join_back, prepare, stage_table

#: Messages that are put in order together, about.
RANGE_ROWS = 50_000
_QUOTE = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_PARSED = "conv_id long, turn long, role string, content string, keys array<struct<a:long,b:long>>, quotes array<struct<level:int,size:int,a:long,b:long>>"


def parse(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """A message without its quotes, its own passages and lines, and the quoted (level, passage or line) pairs."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        level = m.group(1).count(">") if m else 0
        rest = line[m.end() :] if m else line
        if level == 0:
            own.append(line)
        if not rest.strip() and level == 0:
            blocks.append((0, []))
        elif blocks and blocks[-1][0] == level and blocks[-1][1]:
            blocks[-1][1].append(rest)
        else:
            blocks.append((level, [rest]))
    content = "\n".join(own).strip() if any(level for level, _ in blocks) else text
    passages = [p for level, lines in blocks if level == 0 and lines for p in ("\n".join(lines), *lines)]
    quoted = [(level, p) for level, lines in blocks if level for p in ("\n".join(lines), *lines)]
    return content, [content, *passages], quoted


def key(passage: str) -> tuple[int, int] | None:
    """128-bit hash of the normalised passage as two longs; None for blank ones."""
    norm = " ".join(passage.casefold().split())
    if not norm:
        return None
    h = xxhash.xxh3_128_intdigest(norm)
    return tuple(int.from_bytes(p, "little", signed=True) for p in (h.to_bytes(16, "little")[:8], h.to_bytes(16, "little")[8:]))


def parsed(messages: DataFrame) -> DataFrame:
    prepare(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        quote = pa.struct([("level", pa.int32()), ("size", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            contents, keys, quotes = [], [], []
            for text in b.column(3).to_pylist():
                content, own, quoted = parse(text or "")
                contents.append(content if text is not None else None)
                keys.append([{"a": k[0], "b": k[1]} for k in {key(p) for p in own} if k])
                quotes.append([{"level": n, "size": len(p), "a": k[0], "b": k[1]} for n, p in quoted if (k := key(p))])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(contents, pa.string()), pa.array(keys, pa.list_(pair)), pa.array(quotes, pa.list_(quote))], ["conv_id", "turn", "role", "content", "keys", "quotes"])

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(run, _PARSED)


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, role, content, n_quotes, reply_to, thread), one row for each message.

    content is the text without quoted lines (null for null texts), n_quotes the number of quoted passages and lines.
    reply_to is the turn that wrote the quoted text first: of the lowest quote level, then of the longest passage that
    an earlier turn of the conversation has; null if there is none. thread is the first turn reached over reply_to.
    Ordered by (conv_id, thread, turn), every message comes after that it replies to. Messages without a conv_id or
    turn are kept, unlinked; repeated rows are kept, and their turn counts once as a place. Empty input: no rows.
    """
    rows = stage_table(parsed(messages), "messages")
    places = rows.where("conv_id is not null and turn is not null")
    asked = places.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    if asked.isEmpty():
        out = rows.withColumn("reply_to", F.lit(None).cast("long")).withColumn("thread", F.col("turn"))
        return out.select("conv_id", "turn", "role", "content", F.size("quotes").cast("long").alias("n_quotes"), "reply_to", "thread")
    asked = asked.withColumn("k", F.xxhash64("conv_id", "a", "b"))
    written = places.select("conv_id", "turn", F.explode("keys").alias("k")).select("conv_id", "turn", "k.*")
    first = written.groupBy("conv_id", "a", "b").agg(F.min("turn").alias("origin")).withColumn("k", F.xxhash64("conv_id", "a", "b"))
    uses = asked.groupBy("k", "conv_id", "a", "b").agg(F.count("*").alias("c"))
    first = first.join(uses, ["k", "conv_id", "a", "b"])
    found = join_back(asked, first, ["k", "conv_id", "a", "b"], ["origin"], "c", max(1, asked.count()), F.struct("turn", "size", "level"))
    best = F.max(F.struct(-F.col("level"), F.col("size"), F.col("origin"))).alias("best")
    replies = found.where("origin < turn").groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.origin").alias("reply_to"))
    replies = stage_table(replies, "replies")
    roots = _roots(replies)
    n = max(1, rows.count())
    about = replies.join(roots, ["conv_id", "turn"])
    sizes = places.groupBy("conv_id", "turn").agg(F.count("*").alias("c"))
    about = about.join(sizes, ["conv_id", "turn"])
    out = join_back(rows, about, ["turn", "conv_id"], ["reply_to", "thread"], "c", n, F.struct("conv_id", "content"))
    return out.select("conv_id", "turn", "role", "content", F.size("quotes").cast("long").alias("n_quotes"), "reply_to", F.coalesce("thread", "turn").alias("thread"))


def _roots(replies: DataFrame, rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread): jumps double each round, so a chain of n replies takes log n of them."""
    at = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    n = max(1, at.count())
    for _ in range(rounds):
        uses = at.groupBy("conv_id", "thread").agg(F.count("*").alias("c"))
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next")).join(uses, ["conv_id", "thread"])
        step = join_back(at, up, ["thread", "conv_id"], ["next"], "c", n, F.col("turn"))
        step = stage_table(step.select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return at


def reply_order(linked: DataFrame) -> DataFrame:
    """``linked`` with position, the message's place in its conversation from 1, by thread, then turn: each comes after that it replies to.

    Rows of one turn follow each other by role and hash of the content. Rows are sorted in ranges of all of these, and
    ranges are numbered on from one another, so that a conversation of any length is spread over tasks.
    """
    order = [F.col("conv_id"), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("content")]
    ranges = max(1, -(-linked.count() // RANGE_ROWS))
    rows = linked.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = stage_table(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    place, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # the range and the place in it
    counts = sorted(tuple(r) for r in rows.groupBy(place.alias("p")).count().collect())  # one for about RANGE_ROWS rows
    starts, past = [], 0
    for p, c in counts:
        starts.append((p, past))
        past += c
    starts = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    rows = rows.withColumn("_p", place).join(F.broadcast(starts), "_p").withColumn("_number", F.col("_start") + within)
    firsts = rows.groupBy("conv_id").agg(F.min("_number").alias("_first"), F.count("*").alias("_c"))
    nulls = firsts.where("conv_id is null").head()
    known = join_back(rows, firsts.where("conv_id is not null"), ["conv_id"], ["_first"], "_c", max(1, past), F.col("_number"))
    first = F.coalesce("_first", F.lit(nulls["_first"] if nulls else 0))
    return known.select(*linked.columns, (F.col("_number") - first + 1).alias("position"))


def conversations(linked: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, part, n_messages, messages): each conversation's messages in reply order, quotes left out, ``block`` to a row.

    messages holds structs (position, thread, turn, reply_to, role, content). Rows that repeat are messages of their
    own. Messages without a conv_id stand together; those without a turn come last. Empty input: no rows.
    """
    rows = reply_order(linked).withColumn("part", F.floor((F.col("position") - 1) / block))
    messages = F.sort_array(F.collect_list(F.struct("position", "thread", "turn", "reply_to", "role", "content")))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_messages"), messages.alias("messages"))
