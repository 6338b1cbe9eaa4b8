"""Extraction: exact marginals, held-out layouts, pages without wrappers, and time in proportion to length."""

from __future__ import annotations

import itertools
import math
import time
from collections import Counter

import pytest

from codeloom.llm.html_extract import Model, extract, main_text, trained
from codeloom.llm.html_pages import labelled_page, labels
from codeloom.llm.html_tree import Tree

LONG = "This is a fairly long text, with several sentences in it. It should be kept as the main text of the page. There is more of it here."


def test_marginals_like_enumeration():
    model = Model({"text p": 0.7, "size 1": -0.4, "frame div": 0.3, "linked p 4": -1.5, "class ad": -2.0}, -0.2, [[0.0, 0.0], [-0.6, 1.3]])
    for page in ("<div><p>a b</p><p><a href='#'>c</a></p><div class=ad>x</div></div>", "<div><div><p>a</p></div><span class='ad'>y</span></div>z", "", "<p>a"):
        tree = Tree(page)
        n, rows = len(tree.tag), tree.features()
        total, content = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            score = sum(y * (model.bias + sum(model.weights.get(f, 0.0) for f in row)) for y, row in zip(states, rows, strict=True))
            score += sum(model.pair[states[tree.parent[i]]][states[i]] for i in range(1, n))
            total += math.exp(score)
            for i in range(n):
                content[i] += states[i] * math.exp(score)
        assert model.marginals(tree) == pytest.approx([c / total for c in content])


def test_held_out_layouts():
    """Pages that the potentials weren't trained on: with and without wrappers, class names, links, and end tags."""
    scores = []
    for seed in range(500_000, 500_400):
        page, outside = labelled_page(seed)
        tree = Tree(page)
        want, got = (Counter(t.split()) for t in (" ".join(tree.blocks(labels(tree, outside))), extract(page, trained())[0]))
        both = sum((want & got).values())
        scores.append(2 * both / (want.total() + got.total()) if want or got else 1.0)
    assert sum(scores) / len(scores) >= 0.95


@pytest.mark.parametrize("page", [f"<body><p>{LONG}</p></body>", f"<body>{LONG}</body>", f"<div>{LONG}</div>", f"<html><body><div><div><div>{LONG}</div></div></div></body></html>", LONG])
def test_pages_without_wrappers(page):
    assert extract(page, trained())[0] == LONG


def test_parts_of_pages():
    text = lambda page: extract(page, trained())[0]
    assert text(f"<article><p><a href=x>{LONG}</a></p><p>{LONG}</p></article>") == f"{LONG} {LONG}"
    assert text(f"<article><p>{LONG}</p><footer>Posted by someone</footer></article>") == LONG
    assert text(f"<body><div>We use cookies to improve this site.</div><p>{LONG}</p><p>{LONG}</p></body>") == f"{LONG} {LONG}"
    assert text(f"<article><p>{LONG} <span class='ad'>Buy now</span> and <b>more</b>text</p><span class='ad'>Great thing</span><p>{LONG}</p></article>") == f"{LONG} and moretext {LONG}"
    assert text(f"<div><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></div><div>{LONG}</div><div>© 2020 Example, all rights reserved</div>") == LONG
    assert text(f"<nav><a href='/'>Home</a></nav><article><h1>Head &amp; line</h1><p>The  first\n&lt;b&gt;.</p><p>{LONG}</article><footer>x</footer>") == f"Head & line The first <b>. {LONG}"


def test_long_odd_pages():
    start = time.perf_counter()
    for page in ("<div>" * 3000 + "</p></b></em>" * 30_000, "<div><b>" * 3000 + "<li>x" * 30_000 + "</i></i>" * 10_000, "<svg><g>" * 20_000 + "</p>" * 20_000, "<a href=x>" * 30_000 + "</a>" * 30_000):
        Tree(page).features()
    assert time.perf_counter() - start < 15


def test_odd_rows(spark):
    rows = [(1, "u", f"<p>{LONG}"), (1, "u", f"<p>{LONG}"), (None, None, None), (2, "u", ""), (3, "u", "<p>a &lt; b")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert got == [(1, LONG, len(LONG)), (1, LONG, len(LONG)), (None, "", 0), (2, "", 0), (3, "a < b", 5)]
