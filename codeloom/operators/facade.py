"""What a user asks for in one call, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import hybrid, navigation, search, store, vector_search

# Kinds whose symbols are embedded even without signature or comment.
EMBEDDED_KINDS = ("function", "class", "method", "interface", "enum", "type")


def embeddable(symbols: DataFrame, root: str = "", kinds: tuple[str, ...] = EMBEDDED_KINDS) -> DataFrame:
    """Symbols below ``root`` to embed, with content, by kind and name: those with a signature or comment, or of some kinds; none without text."""
    doc = F.col("doc_comment") if "doc_comment" in symbols.columns else F.lit(None).cast("string")
    rows = symbols.where(F.startswith("file_path", F.lit(root)) & (F.col("signature").isNotNull() | doc.isNotNull() | F.col("kind").isin(*kinds)))
    rows = rows.withColumn("content", T.search_content(F.col("name"), F.col("signature"), doc))
    return rows.where(F.trim("content") != "").orderBy("kind", "name")


def semantic_index(symbols: DataFrame, root: str = "", size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, vectors in long form) of all symbols to embed: one job for what a loop over batches would do."""
    rows = embeddable(symbols, root).select("id", "content")
    terms = vector_search.doc_terms(rows, "id", "content")
    vocab = vector_search.vocabulary(terms, rows.count(), size)
    return vocab, vector_search.weights(terms, vocab, "id")


def with_metadata_of(vectors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Vectors (id, ...) with their symbol's name, kind and file, null for unknown symbols."""
    return vectors.join(symbols.select("id", "name", "kind", "file_path"), "id", "left")


def overview(symbols: DataFrame, files: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(section, name, n): totals, the commonest kinds and languages, and layers of the files' paths."""
    totals = store.statistics(symbols, files, edges).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("symbols", "files", "relationships"))), F.array("symbols", "files", "relationships"))).alias("name", "n"))
    best = lambda column: store.by(symbols, column).orderBy(F.desc("n"), column).limit(top).select(F.col(column).alias("name"), "n")
    layers = symbols.groupBy(T.layer(F.col("file_path")).alias("name")).agg(F.count("*").alias("n"))
    parts = {"total": totals, "kind": best("kind"), "language": best("language"), "layer": layers}
    out = None
    for section, rows in parts.items():
        rows = rows.select(F.lit(section).alias("section"), "name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def find(symbols: DataFrame, edges: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The best hits by name with the number of references to each."""
    hits = search.ranked(symbols, query, limit)
    counts = edges.join(hits.select(F.col("key").alias("to_key")), "to_key", "left_semi").groupBy(F.col("to_key").alias("key")).agg(F.count("*").alias("n_references"))
    return hits.join(counts, "key", "left").withColumn("n_references", F.coalesce("n_references", F.lit(0))).orderBy("match_rank", "name", "id")


def first_hit(symbols: DataFrame, query: str) -> DataFrame:
    """The best hit by name: one row or none."""
    return search.ranked(symbols, query, 1)


def definition(symbols: DataFrame, query: str) -> DataFrame:
    """Where the best hit is defined."""
    return first_hit(symbols, query).select("key", "id", "name", "kind", "file_path", "start_line", "end_line")


def _neighbours(symbols: DataFrame, edges: DataFrame, query: str, incoming: bool, limit: int, kinds: tuple[str, ...]) -> DataFrame:
    here, there = ("to_key", "from_key") if incoming else ("from_key", "to_key")
    hit = first_hit(symbols, query).select(F.col("key").alias(here))
    found = edges.where(F.col("kind").isin(*kinds)).join(hit, here, "left_semi").select(F.col(there).alias("key")).distinct()
    return symbols.join(found, "key").orderBy("name", "id").limit(limit)


def trace(symbols: DataFrame, edges: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(direction, id, name): callers and callees of the best hit, ``limit`` each."""
    side = lambda incoming: _neighbours(symbols, edges, query, incoming, limit, ("calls",)).select(F.lit("in" if incoming else "out").alias("direction"), "id", "name")
    return side(True).unionByName(side(False))


def understand(symbols: DataFrame, types: DataFrame, query: str) -> DataFrame:
    """The best hit with its signature, its type if one is known, layer and tags."""
    hit = first_hit(symbols, query).join(types.select(F.col("symbol_id").alias("id"), "resolved_type"), "id", "left")
    return hit.select("id", "name", "signature", "resolved_type", T.layer(F.col("file_path")).alias("layer"), T.pattern_tags(F.col("name"), F.col("kind")).alias("tags"))


def related(symbols: DataFrame, edges: DataFrame, links: DataFrame, query: str, n_references: int = 12, n_bindings: int = 5) -> DataFrame:
    """(relation, key, name, file_path): what refers to the best hit, and what it is bound to in other languages."""
    refs = _neighbours(symbols, edges, query, True, n_references, navigation.REFERENCE_KINDS).select(F.lit("reference").alias("relation"), "key", "name", "file_path")
    hit = first_hit(symbols, query).select(F.col("key").alias("source_key"))
    bound = links.join(hit, "source_key", "left_semi").select(F.col("target_key").alias("key")).distinct()
    bound = symbols.join(bound, "key").orderBy("name", "id").limit(n_bindings).select(F.lit("binding").alias("relation"), "key", "name", "file_path")
    return refs.unionByName(bound)


def implementations(symbols: DataFrame, edges: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols that implement or extend the best hit; where no such edges are known, those that refer to it from other files."""
    real = _neighbours(symbols, edges, query, True, limit, ("implements", "extends"))
    if not real.isEmpty():
        return real
    own = first_hit(symbols, query).select("file_path")
    return _neighbours(symbols, edges, query, True, limit, navigation.REFERENCE_KINDS).join(own, "file_path", "left_anti").orderBy("name", "id")


def search_code(symbols: DataFrame, query: str, semantic: DataFrame | None = None, threshold: float = 0.7, limit: int = 50, language: str | None = None, kinds: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Hits by name and, where hits by meaning (id, score) are given, by both; filters hold for either way.

    An empty query finds nothing.
    """
    rows = search.filtered(symbols, language, kinds, path)
    if not query.strip():
        return rows.limit(0)
    by_name = search.ranked(rows, query, limit)
    if semantic is None:
        return by_name
    inside = semantic.join(rows.select("id"), "id", "left_semi")
    return hybrid.merge(by_name, inside, rows, query, threshold, limit)


def explore_code(symbols: DataFrame, edges: DataFrame, query: str, limit: int = 15) -> DataFrame:
    """One row (n, layers, patterns, n_relationships, advice) about the best hits of a query: the edges are those between them."""
    hits = search.ranked(symbols, query, limit).select("key", "name", "kind", "file_path")
    about = hits.agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(T.layer(F.col("file_path")))).alias("layers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.pattern_tags(F.col("name"), F.col("kind")))))).alias("patterns"),
    )
    keys = hits.select("key")
    inside = edges.join(keys.withColumnRenamed("key", "from_key"), "from_key", "left_semi").join(keys.withColumnRenamed("key", "to_key"), "to_key", "left_semi")
    out = about.join(inside.agg(F.count("*").alias("n_relationships")), F.lit(True))
    return out.withColumn("advice", T.explore_advice(F.col("n"), F.col("layers"), F.col("patterns")))


def embedding_progress(symbols: DataFrame, vectors: DataFrame) -> DataFrame:
    """(language, total, embedded, percent) of symbols that have a vector (id)."""
    done = symbols.join(vectors.select("id").distinct().withColumn("_v", F.lit(1)), "id", "left")
    counts = done.groupBy("language").agg(F.count("*").alias("total"), F.count("_v").alias("embedded"))
    return counts.withColumn("percent", T.percent(F.col("embedded"), F.col("total")))


def models(vectors: DataFrame, column: str = "model") -> DataFrame:
    """(model, n): the models that vectors were made by."""
    return vectors.groupBy(column).agg(F.count("*").alias("n"))


def clear_vectors(vectors: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """Vectors without those of symbols below ``root``."""
    gone = symbols.where(F.startswith("file_path", F.lit(root.rstrip("/") + "/"))).select("id")
    return vectors.join(gone, "id", "left_anti")
