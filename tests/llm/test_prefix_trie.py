"""The trie of conversation prefixes against a plain version, SQL, and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from codeloom.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in conversations.values():
        turns.sort()
    out = {}
    for conv, turns in conversations.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conversations.get(conv - conv % 20 if conv >= 0 else conv + -conv % 20, [])
        out[conv] = [t[2:] for t in base[:h]] + [t[2:] for t in turns[h:]]
    return out


def plain_trie(conversations):
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * words
    out = []
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(conversations[c]) == len(path))))
        above = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), above, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame(rows, TURNS))).collect()), key=str)


def test_against_plain(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(130), 4000, 4001, 4019]:
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "x y z", " \n"])))
    rows += [(7, None, "user", "null turn first"), (8, 1, "user", "a"), (8, 1, "user", "a"), (None, 1, "user", "no conversation")]
    rows += [(60, t, "user", f"turn {t % 3}") for t in range(10, 700)]  # over two blocks of turns, and long chains
    rows += [(61, t, "user", f"turn {t % 3}") for t in range(10, 700)]
    rng.shuffle(rows)
    assert trie(spark, rows) == plain_trie(plain_rebuilt(rows))


def test_hot_prefix(spark):
    """Two thirds of all conversations are one text."""
    rows = [(c, t, "system", f"shared {t}" if c % 3 else f"own {c}") for c in range(3000) for t in range(2)]
    assert trie(spark, rows) == plain_trie(plain_rebuilt(rows))


def test_negative_and_single(spark):
    rows = [(-5, 0, "user", "one two")]
    found = trie(spark, rows)
    assert found == plain_trie(plain_rebuilt(rows))
    # a conversation without turns of its own is a member of the root only
    short = next(c for c in range(20, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(short, 0, "user", "x")]
    assert trie(spark, rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_empty_and_clashing_columns(spark):
    assert trie(spark, []) == []
    rows = [(1, 0, "user", "a b c", 9, 9, "k"), (2, 0, "user", "a b c", 8, 8, "l")]
    df = spark.createDataFrame(rows, TURNS + ", depth long, k1 long, place string")
    got = sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).collect()), key=str)
    assert got == plain_trie(plain_rebuilt([r[:4] for r in rows]))


def test_like_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    df = queries.op11_prefix_trie(spark, small)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op11_prefix_trie']}) x").fetchall(), key=str)
    assert got == plain_trie(plain_rebuilt(rows))
