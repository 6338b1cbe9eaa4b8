"""Orders of rows with repeated, hot and null keys, against plain sorting; conversations against a plain version."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm import fingerprints, quotes

MESSAGES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("hot", [False, True])
def test_next_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    rng = random.Random(2)
    rows = [(rng.choice((None, 5, 5, 5, 5, 9) if hot else (None, *range(40))), f"text {i % 70}") for i in range(300)] + [(3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = Counter((a["doc_id"], a["t"], b["doc_id"], b["t"]) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter(tuple(r) for r in fingerprints.with_next(docs).collect()) == want


def plain_conversations(rows):
    """reply_to of each message by comparing all passages with all earlier messages, and its thread."""
    norm = lambda t: " ".join(t.casefold().split())
    first = {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            for p in quotes.parse(text or "")[1]:
                if norm(p):
                    first[conv, norm(p)] = min(turn, first.get((conv, norm(p)), turn))
    best = defaultdict(list)
    for conv, turn, _, text in rows:
        if turn is not None:
            best[conv, turn] += [(-level, len(p), first[conv, norm(p)]) for level, p in quotes.parse(text or "")[2] if first.get((conv, norm(p)), turn) < turn]
    replies = {at: max(found)[2] for at, found in best.items() if found}
    out = []
    for conv, turn, role, text in rows:
        at = turn
        while (conv, at) in replies:
            at = replies[conv, at]
        content = None if text is None else quotes.parse(text)[0]
        out.append((conv, turn, role, content, replies.get((conv, turn)), at))
    return out


@pytest.fixture(scope="module")
def threads():
    """Conversations with nested quotes, a passage that all quote, a long chain of replies and odd rows."""
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        said = ["Hot passage that all quote."]
        for turn in range(rng.randrange(1, 15)):
            text = f"Message {conv} {turn}\nwith a line {rng.randrange(5)}" if turn else said[0]
            if turn and rng.random() < 0.7:
                quoted = rng.choice(said)
                text = "\n".join("> " + x for x in quoted.upper().split("\n")) + "\n" + text
            if turn > 2 and rng.random() < 0.3:
                text = ">> " + said[0] + "\n" + text
            said.append(text.split("\n")[-1])
            rows.append((conv, turn, rng.choice(("user", "assistant")), text))
    rows += [(50, 0, "user", "start 0")] + [(50, i, "user", f"> start {i - 1}\nstart {i}") for i in range(1, 80)]
    rows += [(1, 0, "user", None), (None, 3, "user", "> x\ny"), (2, None, "user", "z"), (None, None, None, None), rows[5], rows[5]]
    return rows


def test_links_like_plain_version(spark, threads):
    got = Counter((r["conv_id"], r["turn"], r["role"], r["content"], r["reply_to"], r["thread"]) for r in quotes.link_quotes(spark.createDataFrame(threads, MESSAGES)).collect())
    assert got == Counter(plain_conversations(threads))


def test_conversations_in_reply_order(spark, threads, monkeypatch):
    monkeypatch.setattr(quotes, "RANGE_ROWS", 20)
    found = quotes.conversations(quotes.link_quotes(spark.createDataFrame(threads, MESSAGES)), block=16).collect()
    held = defaultdict(list)
    for r in sorted(found, key=lambda r: r["part"]):
        assert r["n_messages"] == len(r["messages"]) <= 16
        held[r["conv_id"]] += r["messages"]
    want = defaultdict(list)
    for conv, turn, role, content, reply_to, thread in plain_conversations(threads):
        want[conv].append((thread, turn, reply_to, role, content))
    last = lambda x: (x is None, x or 0)
    for conv, messages in held.items():
        assert [m["position"] for m in messages] == list(range(1, len(messages) + 1))
        got = [(m["thread"], m["turn"], m["reply_to"], m["role"], m["content"]) for m in messages]
        assert Counter(got) == Counter(want[conv])
        assert [m[:2] for m in got] == sorted((m[:2] for m in want[conv]), key=lambda m: (last(m[0]), last(m[1])))
        seen = set()
        for _, turn, reply_to, _, _ in got:
            assert reply_to is None or reply_to in seen
            seen.add(turn)
    assert held.keys() == want.keys()


def test_empty_conversations(spark):
    assert quotes.conversations(quotes.link_quotes(spark.createDataFrame([], MESSAGES))).collect() == []
