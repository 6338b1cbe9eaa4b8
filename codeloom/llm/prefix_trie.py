"""Trie of conversation prefixes with subtree totals by pointer jumping.

A prefix's digest is the XOR of 128-bit hashes of its turns, each with its place; so the digests of all prefixes are a
running XOR, taken in blocks of turns and then over blocks, and no long conversation meets in one task. Equal digests
of different prefixes are as likely as two equal random numbers of 128 bits. Nodes are the distinct digests; each
knows its parent's. In round k every node's pointer leads 2^k levels up: what has been summed below a node is added to
the one that its pointer names, then pointers double. A trie of depth d takes log d rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import discard, join_back, stage_table

#: Rows that are put in order together, about.
RANGE_ROWS = 50_000
#: Turns of a conversation whose digests are chained together.
BLOCK_TURNS = 512
#: Decimal ids that are joined together, at most.
CHUNK_IDS = 8192
_KEY = ["k1", "k2", "depth"]


def number_in_groups(rows: DataFrame, group: str, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``, the place from 1 in the rows of the same ``group`` (long, not null), by ``order``, nulls first.

    Rows are sorted in ranges of group and order, and ranges are numbered on from one another, so that a group of any
    size is spread over tasks.
    """
    keys = [F.col(group), *[F.col(c) if isinstance(c, str) else c for c in order]]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    at = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    at = stage_table(at.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(tuple(r) for r in at.groupBy(part.alias("p")).count().collect())  # one for about RANGE_ROWS rows
    starts, past = [], 0
    for p, c in counts:
        starts.append((p, past))
        past += c
    starts = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    at = at.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn("_n", F.col("_start") + within)
    firsts = at.groupBy(group).agg(F.min("_n").alias("_first"), F.count("*").alias("_c"))
    at = join_back(at, firsts, [group], ["_first"], "_c", max(1, past), F.col("_n"))
    return at.select(*rows.columns, (F.col("_n") - F.col("_first") + 1).alias(name))


def rebuilt(conversations: DataFrame, every: int = 20, kept: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, role, text) and lengths (conv_id, length) of conversations that take up others' beginnings.

    Conversation c begins with the first h turns of conversation c - c % every, where h is the unsigned crc32 of c's
    decimal form modulo ``kept`` (all if there are fewer, none if there is no such conversation), and goes on with its
    own turns after its first h. Depth counts from 1. Turns are ordered by turn, nulls first; rows of one turn by role and
    text. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = stage_table(number_in_groups(rows, "conv_id", ["turn", "role", "text"], "place"), "turns")
    sizes = stage_table(rows.groupBy("conv_id").agg(F.count("*").alias("size")), "sizes")
    taken = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % kept
    about = sizes.select("conv_id", "size", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    about = about.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_size", F.lit(0))))
    about = stage_table(about.withColumn("length", F.col("lent") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "about")
    heads = rows.where(F.col("place") < kept).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "role", "text")
    heads = about.where("lent > 0").select("conv_id", "base", "lent").join(heads, "base").where("depth <= lent")  # fewer than kept * every rows for each base
    own = join_back(rows, about, ["conv_id"], ["h", "lent"], "size", max(1, rows.count()), F.col("place"))
    own = own.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("depth"), "role", "text")
    return heads.select("conv_id", "depth", "role", "text").unionByName(own), about.select("conv_id", "length")


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text) -> (conv_id, depth, k1, k2, words): the digest of each conversation's first ``depth`` turns, and the words of the last of them."""
    one = turns.select(
        "conv_id", "depth", F.floor(F.col("depth") / BLOCK_TURNS).alias("block"),
        F.xxhash64(F.lit(1), "depth", "role", "text").alias("a"), F.xxhash64(F.lit(2), "depth", "text", "role").alias("b"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    one = stage_table(one, "hashes")
    blocks = one.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in "ab"])
    until = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = one.select("conv_id", "block", "depth", "words", *[F.bit_xor(c).over(until).alias(c) for c in "ab"])
    both = within.join(blocks, ["conv_id", "block"])
    return both.select("conv_id", "depth", F.col("a").bitwiseXOR(F.col("_a")).alias("k1"), F.col("b").bitwiseXOR(F.col("_b")).alias("k2"), "words")


def joined_ids(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, conv_id) -> (k1, k2, depth, ends_sha256), of each key's ids in ascending order joined by commas.

    Ids are sorted and joined in ranges; only the chunks of a key are hashed one after the other, as a stream.
    """
    columns = [*_KEY, "first", "ids"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in (*key, ids[0])], pa.array([",".join(map(str, ids))])], columns)

        for b in batches:
            for k1, k2, depth, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (key != (k1, k2, depth) or len(ids) == CHUNK_IDS):
                    yield chunk()
                    ids = []
                key = k1, k2, depth
                ids.append(conv)
        if ids:
            yield chunk()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in batches:
            for k1, k2, depth, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == (k1, k2, depth):
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2, depth), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_KEY, "ends_sha256"])
                out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], [*_KEY, "ends_sha256"])

    ranges = max(1, -(-ends.count() // RANGE_ROWS))
    order = [*_KEY, "conv_id"]
    chunks = ends.select(*order).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    chunks = chunks.mapInArrow(join, "k1 long, k2 long, depth long, first long, ids string")
    chunks = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return chunks.mapInArrow(digest, "k1 long, k2 long, depth long, ends_sha256 string")


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, depth, p1, p2, values) -> the keys with the sums of ``values`` over each node's subtree.

    (p1, p2) is the parent, one level up; the root, at depth 0, has none. One round for each doubling of the depth.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    at = nodes.select(*_KEY, *values, F.col("p1").alias("j1"), F.col("p2").alias("j2"))
    step, old = 1, None
    while step <= deepest:
        given = at.where(F.col("depth") >= step).groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2"), (F.col("depth") - step).alias("depth"))
        given = stage_table(given.agg(*[F.sum(v).alias(f"_{v}") for v in values], F.count("*").alias("_c")), "given")
        sums = at.join(given.drop("_c"), _KEY, "left").select(*_KEY, *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], "j1", "j2")
        jumps = at.where(F.col("depth") >= step).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), (F.col("depth") + step).alias("_d"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        uses = given.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), (F.col("depth") + step).alias("_d"), "_c")
        jumps = uses.join(jumps, ["j1", "j2", "_d"])
        far = sums.where(F.col("depth") >= 2 * step).withColumn("_d", F.col("depth"))
        far = join_back(far, jumps, ["j1", "j2", "_d"], ["n1", "n2"], "_c", max(1, far.count()), F.col("k1"))
        near = sums.where(F.col("depth") < 2 * step)
        nothing = F.lit(None).cast("long")
        both = far.select(*_KEY, *values, F.col("n1").alias("j1"), F.col("n2").alias("j2")).unionByName(near.select(*_KEY, *values, nothing.alias("j1"), nothing.alias("j2")))
        at = stage_table(both, "sums")
        discard(given, *([old] if old is not None else []))
        old, step = at, 2 * step
    return at.select(*_KEY, *values)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Turns (conv_id, depth, role, text), depths from 1 without gaps, and lengths (conv_id, length), one row for each conversation -> one row for each node.

    A node is a distinct sequence of a conversation's first turns, by role and text; the root is the empty one. Its
    members are the conversations that begin with it. Returned: conv_id, the smallest member; depth; parent_conv_id, of the
    parent (root: null); n_convs members; n_children; n_leaves, nodes without children in the subtree, itself included;
    saved_tokens, the sum over the subtree of (members - 1) * words of the last text; ends_sha256, of the comma-joined
    ascending ids of the members that end here. Conversations without turns are members of the root. No conversations: no rows.
    """
    digests = stage_table(prefix_digests(turns), "prefixes")
    # a node's parent: its digest without the last turn, which the conversation's row one level up holds
    up = digests.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    rows = digests.join(up, ["conv_id", "depth"], "left").withColumn("p1", F.coalesce("p1", F.lit(0))).withColumn("p2", F.coalesce("p2", F.lit(0)))
    nodes = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("words").alias("words"))
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in _KEY], "conv_id", "n_convs", nothing.alias("p1"), nothing.alias("p2"), zero.alias("words"))
    nodes = stage_table(nodes.select(*root.columns).unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stage_table(nodes, "counted")
    sums = roll_up(nodes, ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("_d"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = nodes.drop("n_leaves", "saved_tokens").withColumnRenamed("n_children", "_n").withColumn("_d", F.col("depth"))
    below = join_back(below, parents, ["p1", "p2", "_d"], ["parent_conv_id"], "n_children", max(1, nodes.count()), F.col("k1"))
    ends = lengths.join(digests, (lengths["conv_id"] == digests["conv_id"]) & (lengths["length"] == digests["depth"]), "left")
    ends = ends.select(*[F.coalesce(digests[c], zero).alias(c) for c in _KEY], lengths["conv_id"])
    found = below.join(sums, _KEY).join(joined_ids(ends), _KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("_n").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
