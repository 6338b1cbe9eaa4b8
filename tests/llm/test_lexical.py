"""Block-Max search against scoring every document, and odd inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from codeloom.llm import lexical, queries

TERM = re.compile(lexical.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, total, df = sum(n > 0 for n in sizes), sum(sizes), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        scores = []
        for (doc, c), n in zip(counted, sizes, strict=True):
            m = 100 - 90 + (90 * n * n_docs) // max(1, total)
            s = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    index = lexical.build_index(spark.createDataFrame(docs, DOCS).repartition(3))
    return sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, ITEMS), k).collect()), key=str)


def test_query(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.op13_lexical_search(spark, small)
    got = sorted(map(tuple, df.collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op13_lexical_search']}) x").fetchall(), key=str)
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{small}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == plain(docs, items)


def test_many_blocks_and_shards(spark, monkeypatch):
    """Terms with many blocks, many ties, documents of very different lengths; small shards, blocks and passes."""
    rng = random.Random(5)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, k=rng.choice([1, 3, 40])) + rng.choices(rare, k=rng.choice([0, 2, 9])))) for i in range(1500)]
    docs += [(5000 + i, "the w1 w1 w2") for i in range(300)]  # equal scores in many shards
    docs += [(9000, "w7 " * 20_000 + "the")]
    items = [(i, " ".join(rng.choices(common, k=2) + rng.choices(rare, k=rng.choice([0, 1, 5, 40])))) for i in range(30)] + [(99, "w1 w2 THE"), (98, "w7")]
    monkeypatch.setattr(lexical, "SHARD_DOCS", 170)
    monkeypatch.setattr(lexical, "BLOCK", 16)
    monkeypatch.setattr(lexical, "PASS_TERMS", 100)
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, k=3) == plain(docs, items, k=3)


def test_skips_blocks(spark):
    """Blocks whose windows can't reach the k-th score stay compressed."""
    docs = [(i, "common filler " + ("rare " * 30 if i in (3, 900) else "") + "pad " * (i % 50)) for i in range(20_000)]
    table = lexical.build_index(spark.createDataFrame(docs, DOCS).coalesce(1)).toArrow()
    shard = lexical.Shard(table, 20_000, sum(len(terms(t)) for _, t in docs), {t: 1 if t in ("common", "filler", "pad") else 5000 for t in set(table["term"].to_pylist())})
    assert {d for _, d in shard.top(["common", "rare"], 2)} == {3, 900}
    opened = sum(d is not None for d in shard.docs)
    assert opened <= lexical.OPENED + 2 < len(range(*shard.of["common"])) // 4


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (None, "Alpha beta"), (None, "alpha BETA"), (4, "alpha"), (4, "alpha"), (5, "Ünïcode ß ÀB"), (6, "x" * 3_000_000 + " alpha")]
    items = [(1, "alpha ALPHA beta"), (1, "alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "ünïcode Ünïcode ß"), (6, "x" * 3_000_000)]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7), (2, "b", "t", 8)], DOCS + ", shard string, term int")
    items = spark.createDataFrame([(1, "b", 3, "q")], ITEMS + ", query int, score string")
    got = sorted(map(tuple, lexical.search(lexical.build_index(docs), items).collect()), key=str)
    assert got == plain([(1, "a b"), (2, "b")], [(1, "b")])


def test_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 2**55])
    data, at = lexical.pack_numbers(values)
    assert lexical.unpack_numbers(data).tolist() == values.tolist() and at.tolist()[:4] == [0, 1, 2, 3]
    assert lexical.unpack_numbers(data[:0]).tolist() == []


@pytest.mark.parametrize("cut", [7, 64, 1 << 20])
def test_terms(cut, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", cut)
    text = "The quick-brown fox_42 ÄÖ é  " * 20 + "z" * 300
    data = text.encode().lower()
    starts, ends, hashes = lexical.terms_of(data)
    words = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
    assert words == terms(data.decode())
    assert len(set(hashes.tolist())) == len(set(words)) and len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words))
