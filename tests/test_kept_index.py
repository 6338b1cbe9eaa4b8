"""The maintained index against a rebuild and brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.functions.stem import porter
from codeloom.operators import kept_index, search

DOCS = "id int, name string, body string"
FIRST = [
    (1, "User service", "fetches the users of a service, and connects them"),
    (2, "connection pool", "connected connections are connecting"),
    (3, None, "the quick brown fox"),
    (4, "fox", "the quick brown the quick red fox"),
    (5, "empty", ""),
    (6, None, None),
    (7, "calculateTotal", "calculate totals of services"),
]
CHANGED = [(2, "pool", "nothing to see"), (8, "new", "the quick fox connects")]


def terms(row):
    return [[t for t in re.split(r"[\s\W]+", (f or "").lower(), flags=re.ASCII) if len(t) > 1] for f in row[1:]]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute(docs, query, prefix=False, fuzzy=0.0, stem=False):
    counts = {d[0]: Counter(t for f in terms(d) for t in f) for d in docs}
    lengths = {k: sum(c.values()) for k, c in counts.items()}
    n, average = len(docs), sum(lengths.values()) / len(docs)
    vocabulary = {t for c in counts.values() for t in c}
    out = Counter()
    for q in set(search._query_terms(query)):
        weights = {}
        for t in vocabulary:
            options = [1.0] if t == q or stem and porter(t) == porter(q) else []
            options += [0.75 * len(q) / len(t)] if prefix and t.startswith(q) else []
            edits = int(fuzzy * len(q) + 0.5)
            options += [0.45] if edits and distance(t, q) <= edits else []
            if options:
                weights[t] = max(options)
        groups = [set(weights)] if stem else [{t} for t in weights]
        for g in groups:
            df = sum(any(c[t] for t in g) for c in counts.values())
            for k, c in counts.items():
                tf = sum(c[t] for t in g)
                if tf:
                    w = max(weights[t] for t in g if c[t])
                    out[k] += w * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[k] / average))
    return {k: round(s, 9) for k, s in out.items()}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "kept")
    kept_index.create(spark.createDataFrame(FIRST + [(None, "no", "key")], DOCS), "id", ["name", "body"], path)
    kept_index.update(spark, path, spark.createDataFrame(CHANGED, DOCS), "id", ["name", "body"], gone=spark.createDataFrame([(7,), (99,)], "id int"))
    return path, [d for d in FIRST if d[0] not in (2, 7)] + CHANGED


@pytest.mark.parametrize("query,options", [("quick fox", {}), ("service", {"prefix": True}), ("conects", {"fuzzy": 0.2}), ("foxx servise", {"fuzzy": 0.3, "prefix": True}), ("connected services", {"stem": True}), ("absent", {}), ("", {})])
def test_search_like_a_rebuild(spark, stored, query, options):
    path, docs = stored
    got = {r["id"]: round(r["score"], 9) for r in kept_index.search(spark, path, "id", query, **options).collect()}
    assert got == brute(docs, query, **options)


def test_counts_and_lengths(spark, stored):
    path, docs = stored
    assert kept_index._paths(spark, path)[-1][2:] == (len(docs), float(sum(len(f) for d in docs for f in terms(d))))
    assert {r["id"]: r["length"] for r in kept_index.current_lengths(spark, path, "id").collect()} == {d[0]: sum(map(len, terms(d))) for d in docs}


def test_phrase(spark, stored):
    path, docs = stored
    for words in ("the quick", "the quick brown", "fox the", "quick", "the the", "pool nothing"):
        want = {}
        for d in docs:
            w = words.split()
            n = sum(f[i : i + len(w)] == w for f in terms(d) for i in range(len(f)))
            if n:
                want[d[0]] = n
        assert {r["id"]: r["n"] for r in kept_index.phrase(spark, path, "id", words).collect()} == want


def test_compacting(spark, stored, tmp_path):
    path, docs = stored
    query = "the quick fox connects"
    before = {tuple(r) for r in kept_index.search(spark, path, "id", query).collect()}
    kept_index.compact(spark, path, "id")
    assert [g[:2] for g in kept_index._paths(spark, path)] == [(2, True)]
    assert {tuple(r) for r in kept_index.search(spark, path, "id", query).collect()} == before
    kept_index.vacuum(spark, path)
    assert {tuple(r) for r in kept_index.search(spark, path, "id", query).collect()} == before
    kept_index.update(spark, path, None, "id", ["name", "body"], gone=spark.createDataFrame([(3,)], "id int"))
    got = {r["id"]: round(r["score"], 9) for r in kept_index.search(spark, path, "id", query).collect()}
    assert got == brute([d for d in docs if d[0] != 3], query)


def test_neighbourhood(spark):
    """Every pair of words within two edits shares a neighbour."""
    words = ["get", "gets", "gte", "get_user", "getuser", "user", "usre", "uers", "a", "ab", "", "abcdefgh", "abdcefgh", "badcfehg"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", kept_index.neighbours(F.col("w")).alias("n")).collect()
    near = {r["w"]: set(r["n"]) for r in rows}
    for a in words:
        assert a in near[a] and all(0 <= len(a) - len(x) <= 2 for x in near[a])
        for b in words:
            if distance(a, b) <= 2:
                assert near[a] & near[b], (a, b)


def test_suggest(spark, stored):
    path, _ = stored
    assert kept_index.suggest(spark, path, "serv").first()["term"] == "service"
    assert kept_index.suggest(spark, path, "s").collect() == []
    assert "quick" in [r["term"] for r in kept_index.suggest(spark, path, "quikc", fuzzy=0.4).collect()]


def test_porter():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat sized size hopping hop falling fall hissing hiss filing file happy happi sky sky relational relat rational ration digitizer digit operator oper decisiveness decis sensibiliti sensibl triplicate triplic formalize formal electrical electr goodness good revival reviv allowance allow airliner airlin adjustable adjust replacement replac adoption adopt probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil as as is is".split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]
