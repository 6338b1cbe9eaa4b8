"""Main-text extraction with a tree-structured graphical model.

A page's elements form a tree. Every element is content or not: a unary potential rates its own tag, class names and
text, a pairwise potential ties it to its parent. Sum-product messages go up and then down the tree, once over every
edge, and give each element's exact marginal. Text of elements whose marginal is 0.5 or more is kept, in page order.
The potentials are those of greatest likelihood, given exact marginals, on labelled pages that are generated with
known parts: with and without wrappers, class names, links and end tags.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import prepare
from codeloom.llm.html_pages import labelled_page, labels
from codeloom.llm.html_tree import Tree

#: Labelled pages that the potentials are trained on, steps of training, and the weight of the penalty on large potentials.
TRAINING_PAGES, STEPS, RIDGE = 1600, 70, 0.1


class Model:
    """Log-odds of features, and log potentials of (parent, child) states."""

    def __init__(self, weights: dict[str, float], bias: float, pair: list[list[float]]) -> None:
        self.weights, self.bias, self.pair = weights, bias, pair

    def marginals(self, tree: Tree) -> list[float]:
        """Probability that each element is content."""
        n = len(tree.tag)
        unary = [self.bias + sum(self.weights.get(f, 0.0) for f in row) for row in tree.features()]
        (p00, p01), (p10, p11) = self.pair
        belief, up = list(unary), [0.0] * n
        for i in range(n - 1, 0, -1):
            up[i] = _log_add(p10, p11 + belief[i]) - _log_add(p00, p01 + belief[i])
            belief[tree.parent[i]] += up[i]
        for i in range(1, n):
            # what the parent knows from all but this child
            b = belief[tree.parent[i]] - up[i]
            belief[i] += _log_add(p01, p11 + b) - _log_add(p00, p10 + b)
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, b)))) for b in belief]


def _log_add(a: float, b: float) -> float:
    return (a + math.log1p(math.exp(b - a))) if a > b else (b + math.log1p(math.exp(a - b)))


class _Forest:
    """Labelled trees side by side, for likelihoods and their slopes. Nodes of one depth pass their messages at once."""

    def __init__(self, pages: list[tuple[str, bool]]) -> None:
        trees = [Tree(page) for page, _ in pages]
        sizes = np.array([len(t.tag) for t in trees])
        first = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first, strict=True)])
        self.parent[first] = -1
        self.label = np.concatenate([labels(t, outside) for t, (_, outside) in zip(trees, pages, strict=True)]).astype(float)
        rows = [row for t in trees for row in t.features()]
        self.names = {f: k for k, f in enumerate(sorted({f for row in rows for f in row}))}
        self.index = np.concatenate([[self.names[f] for f in row] for row in rows])
        self.start = np.cumsum([0, *map(len, rows)])[:-1]
        self.row = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        depth = np.zeros(len(rows), int)
        for i, p in enumerate(self.parent):
            depth[i] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.inner = np.flatnonzero(self.parent >= 0)

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative log-likelihood with its penalty, and its slope. theta: weights, bias, potentials of (1, 0) and (1, 1); those of (0, .) are 0."""
        w, bias, p10, p11 = theta[:-3], *theta[-3:]
        unary = np.add.reduceat(w[self.index], self.start) + bias
        belief, up, const = unary.copy(), np.zeros(len(unary)), np.zeros(len(unary))
        for level in reversed(self.levels):
            b, p = belief[level], self.parent[level]
            off = np.logaddexp(0, b)
            up[level] = np.logaddexp(p10, p11 + b) - off
            np.add.at(belief, p, up[level])
            const[level] = off
        roots = self.parent < 0
        total = np.logaddexp(0, belief[roots]).sum() + const.sum()
        both = np.zeros((2, len(unary)))
        for level in self.levels:
            p = self.parent[level]
            rest, own = belief[p] - up[level], belief[level]  # the parent without this child, the child without its parent
            z = np.logaddexp(np.logaddexp(0, own), np.logaddexp(rest + p10, rest + p11 + own))
            both[0, level], both[1, level] = np.exp(rest + p10 - z), np.exp(rest + p11 + own - z)
            belief[level] += np.logaddexp(0, p11 + rest) - np.logaddexp(0, p10 + rest)
        y, up_y = self.label, self.label[self.parent]
        i = self.inner
        given = np.array([(up_y[i] * (1 - y[i])).sum(), (up_y[i] * y[i]).sum()])
        extra = 1 / (1 + np.exp(-np.clip(belief, -50, 50))) - y
        slope = np.concatenate((np.bincount(self.index, extra[self.row], len(w)), [extra.sum()], both[:, i].sum(axis=1) - given))
        fit = total - (unary * y).sum() - given @ theta[-2:]
        return fit + RIDGE / 2 * theta @ theta, slope + RIDGE * theta


def _minimum(loss, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Quasi-Newton descent with limited memory and step halving."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = slope.copy(), []
        for s, g in reversed(past):
            a = s @ d / (s @ g)
            kept.append(a)
            d -= a * g
        d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).max())
        for (s, g), a in zip(past, reversed(kept), strict=True):
            d += s * (a - g @ d / (s @ g))
        size = 1.0
        for _ in range(20):
            found, new = loss(x - size * d)
            if found <= value - 1e-4 * size * (slope @ d):
                break
            size /= 2
        else:
            break
        s, g = -size * d, new - slope
        if s @ g > 1e-10:
            past = [*past[1 - memory :], (s, g)]
        x, slope, done = x + s, new, value - found < 1e-7 * abs(value)
        value = found
        if done:
            break
    return x


@lru_cache(1)
def trained() -> Model:
    """Potentials of greatest penalised likelihood on TRAINING_PAGES generated pages."""
    forest = _Forest([labelled_page(i) for i in range(TRAINING_PAGES)])
    theta = _minimum(forest.loss, np.zeros(len(forest.names) + 3), STEPS)
    return Model({f: float(theta[k]) for f, k in forest.names.items()}, float(theta[-3]), [[0.0, 0.0], [float(theta[-2]), float(theta[-1])]])


def extract(page: str, model: Model) -> tuple[str, int, float]:
    """Main text, number of its blocks, and the smallest distance of a marginal from 0.5."""
    tree = Tree(page)
    marginals = model.marginals(tree)
    blocks = tree.blocks([m >= 0.5 for m in marginals])
    return " ".join(blocks), len(blocks), min(abs(m - 0.5) for m in marginals)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars, n_blocks), one row for each.

    Null, empty and textless pages give an empty text. Truncated pages and unclosed elements are read as far as they
    go; only scripts and the like run to the end of the page. Rows that repeat are extracted each. Empty input: no rows.
    """
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract(h or "", shared.value) for h in b.column(2).to_pylist()]
            texts = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
