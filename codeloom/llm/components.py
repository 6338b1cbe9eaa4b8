"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, join_back, stage_table


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component), the component's smallest node, for every node with an edge.

    Each round first links every node's larger neighbours to its smallest one, then its smaller neighbours; rounds
    end when the edges no longer change (all point to their root). Loops, repeated and null edges are allowed.
    Every round's edges are a table in the shared folder.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = stage_table(e.distinct(), "edges")
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = join_back(both.where("v > u"), least, ["u"], ["m"], "c", 2 * mark[0], F.col("v")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage_table(large.where("a <> b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = join_back(large, least, ["a"], ["m"], "c", max(1, large.count()), F.col("b"))
        pairs = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        old, e = e, stage_table(small.select(pairs.alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "small")
        discard(old, large)
        was, mark = mark, _mark(e)
        if mark == was:
            break
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
