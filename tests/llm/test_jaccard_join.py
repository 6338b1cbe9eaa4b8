"""The n-gram Jaccard join against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from codeloom.llm import jaccard_join
from codeloom.llm.jaccard_join import frequent_tokens, jaccard_components, keep_one_per_component

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, width, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, (_, text) in enumerate(rows):
        words = _WORD.findall((text or "").translate(lower))
        k = min(width, len(words))
        sets[doc] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for d, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(d)] = min(doc, least.get(root(d), doc))
    return Counter((doc, len(sets[d]), least.get(root(d)), links[d]) for d, (doc, _) in enumerate(rows))


def generated(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 4, 12, 40, 90, 150)]
    rows = [(-5, None), (-4, ""), (-3, " \t\n"), (-2, "Ü ü"), (-1, "ü ü")]
    for i in range(220):
        text = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, rng.choice((" ", "\n")).join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_like_brute_force(spark, width, percent):
    rows = generated(width)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert Counter(tuple(r) for r in got.collect()) == brute_force(rows, width, percent)


def test_blocks_and_common_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TOKENS", 1000)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((i * 7, " ".join(words)))
    rows += [(5000 + i, "a very common line " + " ".join(f"r{i}_{j}" for j in range(30))) for i in range(40)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert Counter(tuple(r) for r in got.collect()) == brute_force(rows, 3, 90)


def test_too_many_tokens_of_the_largest_count(spark, monkeypatch):
    monkeypatch.setattr("codeloom.llm.jaccard_join.FREQUENT", 10)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text) for i in range(5)] + [(i, " ".join(f"v{i}_{j}" for j in range(20))) for i in range(5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(frequent_tokens(docs, 3)) == 0
    assert Counter(tuple(r) for r in jaccard_components(docs, 3, 90).collect()) == brute_force(rows, 3, 90)
    often = spark.createDataFrame([(i, "x y z") for i in range(10_500)] + [(i, text) for i in range(20_000, 20_002)], "doc_id long, text string")
    assert len(frequent_tokens(often, 3)) == 1


def test_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = jaccard_components(docs, 3, 90)
    assert Counter(tuple(r) for r in got.collect()) == brute_force(rows, 3, 90)


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "a"), (7, text, "b"), (7, text, "b"), (3, text, "c"), (9, "", "d"), (10, None, "e"), (None, "alone", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(docs, 3, 90).collect()), key=str)
    assert [g for g in got if g[1] == 5] == [(-1, 5, 3), (3, 5, 3), (7, 5, 3), (7, 5, 3)]
    assert (9, 0, 9) in got and (10, 0, 10) in got and len(got) == 7
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["10", "3", "9", "None"]


def test_repeated_and_null_ids(spark):
    """Texts of one doc_id, and rows without one, are compared each by their own text."""
    rng = random.Random(4)
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda words: " ".join("changed" if i == 30 else w for i, w in enumerate(words))
    rows = [(7, " ".join(a)), (7, " ".join(b)), (10, near(b)), (None, " ".join(c)), (9, near(c)), (None, "alone in the world"), (None, "alone in the world"), (7, " ".join(b)), (None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(docs, 3, 90)
    assert Counter(tuple(r) for r in got.collect()) == brute_force(rows, 3, 90)
    kept = Counter((r["doc_id"], r["text"]) for r in keep_one_per_component(docs, 3, 90).collect())
    assert kept == Counter([(7, " ".join(a)), (7, " ".join(b)), (9, near(c)), (None, "alone in the world"), (None, None)])


@pytest.mark.parametrize("drift", [False, True])
def test_components_of_large_groups(spark, monkeypatch, drift):
    """Near copies of an original, or each of the one before it: what stays is the same as by brute force."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(11)
    rows = []
    for family in range(3):
        base = ["common", "words", "first"] + [f"f{family}_{i}" for i in range(90)]
        words = list(base)
        for i in range(70):
            words = list(words if drift else base)
            words[rng.randrange(3, len(words))] = f"x{rng.randrange(10_000)}"
            rows.append((family * 1000 + i, " ".join(words)))
        rows.append((family * 1000 + 500, " ".join(base)))
    want = {c for _, _, c, _ in brute_force(rows, 3, 90)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one_per_component(docs, 3, 90).collect()} == want


def test_near_copies_meet_in_proportion_to_their_number(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 256)
    compared, places = jaccard_join._compared, []
    monkeypatch.setattr(jaccard_join, "_compared", lambda docs, p, *more: (places.append(p.count()), compared(docs, p, *more))[1])
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))] + [(i, " ".join([*base[: i % 90], f"x{i}", *base[i % 90 + 1 :]])) for i in range(1, 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in keep_one_per_component(docs, 3, 90).collect()] == [0]
    assert sum(places) < 10 * len(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs, 3, 90).collect() == []
    assert keep_one_per_component(docs).collect() == []


def test_links_made_by_chance(spark, monkeypatch):
    """With hashes of one byte chance makes many links; comparing whole hashes takes those away that matter."""
    monkeypatch.setattr(jaccard_join, "CHANCE", 40)
    monkeypatch.setattr(jaccard_join._compared, "__defaults__", (1,))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.04 else f"x{i}" for w in base)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {doc: c for doc, _, c, _ in brute_force(rows, 3, 90)}
    assert len(set(want.values())) > 3
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, 3, 90).collect()} == want
