"""TF-IDF models and nearest-neighbour search on dense and sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import code_terms
from codeloom.functions.vectors import as_doubles, cosine


def doc_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): each distinct term of a document once, with tf = 1 / number of its terms."""
    rows = docs.select(key, code_terms(F.col(text)).alias("terms"))
    return rows.select(key, F.explode("terms").alias("term"), (1 / F.size("terms")).alias("tf"))


def vocabulary(terms: DataFrame, n_docs: int, size: int = 1000, min_df: int = 1, max_df: float = 0.9) -> DataFrame:
    """(term, df, idf) of the ``size`` commonest terms with min_df <= df <= floor(n * max_df); idf = ln(n / df), ties by term."""
    counts = terms.groupBy("term").agg(F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= max(min_df, 1)) & (F.col("df") <= int(n_docs * max_df)))
    return kept.orderBy(F.desc("df"), "term").limit(size).withColumn("idf", F.log(F.lit(float(n_docs)) / F.col("df")))


def weights(terms: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, term, w): sparse TF-IDF vectors in long form. The vocabulary is bounded, so it is broadcast."""
    return terms.join(F.broadcast(vocab), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))


def tfidf_search(vectors: DataFrame, vocab: DataFrame, key: str, query_terms: list[str], k: int = 10) -> DataFrame:
    """(key, score): cosine of each sparse vector and the query's. Norms and products come from one pass over the vectors."""
    tf = 1.0 / max(1, len(query_terms))
    asked = vocab.where(F.col("term").isin(query_terms)).select("term", (F.col("idf") * tf).alias("q"))
    rows = vectors.join(F.broadcast(asked), "term", "left")
    sums = rows.groupBy(key).agg(F.sum(F.col("w") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    scored = sums.where("dot > 0").join(F.broadcast(length), F.lit(True)).select(key, (F.col("dot") / (F.col("norm") * F.col("length"))).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def query_confidence(known: int, terms: int) -> float:
    """How much of a query the vocabulary knows."""
    return min(1.0, known / max(terms, 5)) if terms else 0.0


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], k: int = 10, threshold: float = 0.2) -> DataFrame:
    """(key, score) of the k (50 at most) vectors with the best cosine to ``query``, then those of ``threshold`` or more.

    The query is a literal: one scan, and each task keeps its k best.
    """
    q = F.lit([float(x) for x in query]).cast("array<double>")
    scored = vectors.select(key, cosine(as_doubles(F.col(column)), q).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(min(k, 50)).where(F.col("score") >= threshold)


def mean_vectors(vectors: DataFrame, group: str, column: str) -> DataFrame:
    """(group, mean): the mean of each group's vectors, scaled to length 1. Sums are combined before the shuffle."""
    rows = vectors.select(group, F.posexplode(as_doubles(F.col(column))).alias("i", "x"))
    means = rows.groupBy(group, "i").agg(F.avg("x").alias("x"))
    listed = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return listed.select(group, F.transform("v", lambda e: F.when(F.col("norm") == 0, 0.0).otherwise(e.x / F.col("norm"))).alias("mean"))


def entity_mapping(hits: DataFrame, symbols: DataFrame, layer_column: str = "layer") -> DataFrame:
    """(symbols, layers, confidence): hits (id, score) joined to their symbols, with the layers found and the mean score."""
    found = hits.join(symbols, "id")
    return found.agg(
        F.sort_array(F.collect_set("id")).alias("symbols"),
        F.sort_array(F.collect_set(layer_column)).alias("layers"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"),
    )


def upsert(stored: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with the same key.

    Of several new rows of a key the last by ``order`` counts; among equal ones, or without ``order``, that which is last by all columns.
    """
    by = F.struct(*([order] if order else []), *[c for c in new.columns if c not in (key, order)])
    one = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), by).alias("v")).select("v.*")
    return stored.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def chunks(docs: DataFrame, key: str, text: str, size: int = 2048, overlap: int = 200) -> DataFrame:
    """(key, chunk, content): overlapping pieces of ``size`` characters; texts of that many or fewer are one piece."""
    step = size - overlap
    n = F.char_length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    rows = docs.select(key, text, F.posexplode(starts).alias("chunk", "at"))
    return rows.select(key, "chunk", F.substring(F.col(text), F.col("at") + 1, F.lit(size)).alias("content"))
