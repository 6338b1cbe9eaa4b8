"""Toxicity scores of deobfuscated text.

Tokens with digits or signs among their letters, letters repeated three times or more, and letters spaced out one by
one are lattices of what may have been meant: each sign stands for some letters or for nothing, a run of a letter
or sign for one or two, a space between single letters for nothing. A Viterbi search finds the reading that is likeliest under a
character trigram model, counted over all documents. Restored words join the text's own; a lexicon of words and word
beginnings, learnt from labelled rows, rates them, and a logistic model of the ratings gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import give_back, prepare

#: Most labelled rows that the lexicon and the logistic model are fitted on.
TRAINING_ROWS = 20_000
#: Training rows of label 1 in which a lexicon entry occurs, at least, and most entries.
SEEN, ENTRIES = 3, 20_000
#: Rating (log odds in standard errors) from which an entry is telling.
TELLING = 2.5
CLASSES = 64
#: Readings remembered by each worker, at most.
REMEMBERED = 100_000
# Letters that digits and signs stand for in disguised words.
SIGNS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "€": "e",
    "£": "l",
    "(": "c",
}
_WORD = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){2,}[^\W_](?!\S)")
_EDGE = ".,;:?!\"'()[]{}<>%&*#-_/\\~^`|=«»“”„…"


def char_class(c: str) -> int:
    """0 for what isn't a letter, 1-26 for a-z, one of the rest for other letters."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % (CLASSES - 27) if c.isalpha() else 0


_LOW = np.array([char_class(chr(i)) for i in range(0x3000)], np.int64)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the trigrams of character classes of all texts, in lower case. There are CLASSES**3 at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            rows = [t or "" for t in b.column(0).to_pylist()]
            for i in range(0, len(rows), 64):
                codes = np.frombuffer(" ".join(["", *rows[i : i + 64], ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                c = np.where(codes < len(_LOW), _LOW[np.minimum(codes, len(_LOW) - 1)], 27 + codes % (CLASSES - 27))
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["trigram", "n"])

    rows = docs.select("text").mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES**3, np.float64)
    out[rows["trigram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the third class given two, interpolated with those given one and none."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
    return np.log((three + 4 * p2) / (three.sum(axis=2, keepdims=True) + 4)).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each place of a span the readings (letters, log weight)."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(span):
        c, n = span[i], 1
        while i + n < len(span) and span[i + n] == c:
            n += 1
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, -0.5), (c * 2, -0.5 if n == 2 else -1.0)])
        elif c in SIGNS:
            twice = [(x * 2, -1.5) for x in SIGNS[c]] if n > 1 else []
            out.append([*((x, -1.0) for x in SIGNS[c]), *twice, ("", -9.0)])
        else:
            out.append([("", -0.5)])
        i += n
    return out


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case span, as one word; in time proportional to the span, by back-pointers."""
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    steps: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for readings in lattice(span):
        reached: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), score in best.items():
            for letters, weight in readings:
                s, x, y = score + weight, a, b
                for c in letters:
                    k = char_class(c)
                    s += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in reached or s > reached[x, y]:
                    reached[x, y], back[x, y] = s, ((a, b), letters)
        best = reached
        steps.append(back)
    ends = {(a, b): s + float(model[a, b, 0]) for (a, b), s in best.items()}
    most = max(ends.values())
    words = []
    for at in [at for at, s in ends.items() if s == most]:
        parts = []
        for back in reversed(steps):
            at, letters = back[at]
            parts.append(letters)
        words.append("".join(reversed(parts)))
    return max(words)


class Reader:
    """Words of texts, with those that disguised spans were restored to."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model
        self.known: dict[str, str] = {}

    def restore(self, span: str) -> str:
        got = self.known.get(span)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[span] = decode(span, self.model)
        return got

    def read(self, text: str) -> tuple[set[str], list[tuple[str, str]]]:
        """Distinct words in lower case, and the (span, restored word) pairs."""
        text = text.lower()
        words = set(_WORD.findall(text))
        spans = set()
        for t in set(text.split()):
            if not t.isalpha():
                t = t.strip(_EDGE)
                if t and not t.isalpha() and sum(map(str.isalpha, t)) >= 2:
                    spans.add(t)
        if _REPEATED.search(text):
            spans |= {w for w in words if _REPEATED.search(w)}
        spans |= set(_SPACED.findall(text))
        pairs = [(s, self.restore(s)) for s in sorted(spans)]
        words.update(w for _, w in pairs if w)
        return words, pairs


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of three to five letters."""
    return words | {"^" + w[:3] for w in words if len(w) > 3} | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


def rating(t: float, c: float, toxic: float, clean: float) -> float:
    """Log odds of an entry seen in t of ``toxic`` and c of ``clean`` rows, in standard errors."""
    odds = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    return odds / math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def summary(ratings: list[float], words: int) -> list[float]:
    """What the logistic model sees: the best ratings, how many are telling, and their share."""
    telling = [r for r in ratings if r > TELLING]
    top = sorted(telling, reverse=True)[:3]
    return [1.0, min(sum(top), 30.0) / 10, math.log1p(len(telling)), min(1.0, 10 * len(telling) / max(1, words))]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """What scoring needs; everything in it has a fixed largest size."""

    def __init__(self, language: np.ndarray, lexicon: dict[str, tuple[float, float]], toxic: float, clean: float) -> None:
        self.language, self.lexicon, self.toxic, self.clean = language, lexicon, toxic, clean
        self.weights = np.array([-3.0, 1.0, 0.5, 0.0])

    def ratings(self, words: set[str], label: int | None = None) -> list[float]:
        """Ratings of a text's entries; if it is a training row, as they are without it."""
        out = []
        for f in features(words) & self.lexicon.keys():
            t, c = self.lexicon[f]
            out.append(rating(t - (label == 1), c - (label == 0), self.toxic - (label == 1), self.clean - (label == 0)))
        return out

    def score(self, words: set[str]) -> float:
        z = float(np.dot(self.weights, summary(self.ratings(words), len(words))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels`` (doc_id, toxic): at most TRAINING_ROWS of them, those with the smallest hashes of doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    model = Model(log_model(trigram_counts(docs)), {}, 0, 0)
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    held = [(r["doc_id"], int(r["toxic"])) for r in chosen.collect()]  # TRAINING_ROWS at most
    if not held:
        return model
    rows = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(held, "doc_id long, toxic int")), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")  # of several texts of an id the first in byte order
    shared = spark.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        reader, seen = Reader(shared.value.language), (Counter(), Counter())
        n = [0, 0]
        for b in batches:
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n[label] += 1
                seen[label].update(features(reader.read(text or "")[0]))
        clean, toxic = seen
        names = [f for f in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(["", *names]), pa.array([n[1], *(toxic[f] for f in names)], pa.int64()), pa.array([n[0], *(clean[f] for f in names)], pa.int64())], ["entry", "t", "c"])
        names = [f for f in clean if f not in toxic and clean[f] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([clean[f] for f in names], pa.int64())], ["entry", "t", "c"])
        give_back()

    found = rows.mapInArrow(count, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = found.where((F.col("t") >= SEEN) & ((F.col("t") > 2 * F.col("c")) | (F.col("entry") == "")) | (F.col("entry") == "")).orderBy(F.desc("t"), "entry").limit(ENTRIES)
    lexicon = {r["entry"]: (r["t"], r["c"]) for r in found.collect()}
    model.toxic, model.clean = lexicon.pop("", (0, 0))
    model.lexicon = {f: v for f, v in lexicon.items() if rating(*v, model.toxic, model.clean) > TELLING / 2}
    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        m = shared.value
        reader = Reader(m.language)
        for b in batches:
            out = []
            for text, label in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = reader.read(text or "")[0]
                out.append(summary(m.ratings(words, label), len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), b.column(2)], ["x", "toxic"])
        give_back()

    sample = rows.mapInArrow(rate, "x array<double>, toxic int").toPandas()  # TRAINING_ROWS short rows at most
    if len(sample) and sample["toxic"].nunique() == 2:
        order = np.lexsort(np.stack([*np.stack(sample["x"].to_numpy()).T, sample["toxic"].to_numpy()]))
        model.weights = fit_logistic(np.stack(sample["x"].to_numpy())[order], sample["toxic"].to_numpy(float)[order])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id by default) of each row with score, predicted and restored, the disguised spans and what they were read as."""
    prepare(docs.sparkSession)
    keep = keep or ["doc_id"]
    given = keep if "text" in keep else [*keep, "text"]
    at = given.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        m = shared.value
        reader = Reader(m.language)
        for b in batches:
            scores, pairs = [], []
            for text in b.column(at).to_pylist():
                words, restored = reader.read(text or "")
                scores.append(m.score(words))
                pairs.append([f"{s}={w}" for s, w in restored])
            columns = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(pairs, pa.list_(pa.string()))], [*keep, "score", "predicted", "restored"])
        reader.known.clear()
        give_back()

    schema = T.StructType([*docs.select(*keep).schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("restored", T.ArrayType(T.StringType()))])
    return docs.select(*given).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; labels of held-out rows aren't learnt from.

    Null and empty texts have no words and get the score of a text without telling ones. Rows that repeat, or have no
    doc_id, are scored each. Without labels of both kinds the model keeps its first weights. Empty input: no rows.
    """
    model = train(docs, labels.where(~is_held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all columns whatever their names, that aren't predicted to be toxic."""
    model = train(docs, labels.where(~is_held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    kept = score(rows, model, ["row", "text"]).where("predicted = 0")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
