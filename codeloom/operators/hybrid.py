"""Ranking by names, structure and meaning together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import name_similarity, structural_score

# Shares of the three scores, and the structural score of what only meaning found.
NAME, STRUCTURE, MEANING, STRUCTURE_UNKNOWN = 0.3, 0.3, 0.4, 0.2


def merge(structural: DataFrame, semantic: DataFrame, symbols: DataFrame, query: str, threshold: float = 0.3, limit: int = 20) -> DataFrame:
    """Symbols found by name (structural: id) or by meaning (semantic: id, score), with their scores and method, best first.

    Both sides are results of bounded searches; symbols is read once, through a semi-join on their ids.
    """
    a = structural.select("id").distinct().withColumn("by_name", F.lit(True))
    b = semantic.groupBy("id").agg(F.max("score").alias("semantic"))
    both = a.join(b, "id", "full_outer")
    rows = symbols.join(both, "id")
    found = F.coalesce("by_name", F.lit(False))
    name = name_similarity(F.col("name"), F.lit(query))
    shape = structural_score(F.col("kind"), F.col("file_path"), F.col("language"), F.col("end_line") - F.col("start_line"), query)
    rows = rows.withColumn("name_score", name).withColumn("structure_score", F.when(found, shape).otherwise(STRUCTURE_UNKNOWN)).withColumn("semantic_score", F.coalesce("semantic", F.lit(0.0)))
    total = NAME * F.col("name_score") + STRUCTURE * F.col("structure_score") + MEANING * F.col("semantic_score")
    method = F.when(found & F.col("semantic").isNotNull(), "hybrid").when(found, "structural").otherwise("semantic")
    out = rows.withColumn("score", total).withColumn("method", method)
    out = out.withColumn("confidence", F.greatest(F.when(found, (F.col("name_score") + F.col("structure_score")) / 2).otherwise(0.0), F.col("semantic_score")))
    return out.drop("by_name", "semantic").where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(limit)


def budget(limit: int) -> tuple[int, int]:
    """How many fuzzy and exact hits to fetch for ``limit`` results."""
    return -(-7 * 2 * limit // 10), -(-3 * 2 * limit // 10)


def merge_plain(structural: DataFrame, semantic: DataFrame, symbols: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The plain variant of merge: the structural score is 0.7 for what was found by name and 0.2 for the rest; no threshold."""
    a = structural.select("id").distinct().withColumn("by_name", F.lit(True))
    both = a.join(semantic.groupBy("id").agg(F.max("score").alias("semantic")), "id", "full_outer")
    rows = symbols.join(both, "id").withColumn("name_score", name_similarity(F.col("name"), F.lit(query)))
    total = NAME * F.col("name_score") + STRUCTURE * F.when(F.col("by_name"), 0.7).otherwise(STRUCTURE_UNKNOWN) + MEANING * F.coalesce("semantic", F.lit(0.0))
    return rows.withColumn("score", total).drop("by_name", "semantic").orderBy(F.desc("score"), "id").limit(limit)
