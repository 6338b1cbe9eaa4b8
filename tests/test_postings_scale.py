"""Postings are counted where their document is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import kept_index, search


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark, rows):
    return spark.createDataFrame(rows, "id int, text string")


def test_no_shuffle_before_the_index(spark):
    """One row for each term of a document leaves its task, not one for each word."""
    d = docs(spark, [(1, "the cat the dog"), (2, None), (3, "")])
    index, (kept, _) = search.postings(d, "id", ["text"]), kept_index._postings(d, "id", ["text"])
    for df in (index, kept):
        assert "Exchange" not in plan(df) and "Generate" not in plan(kept)
    assert sorted(map(tuple, index.collect())) == [(1, "text", "cat", 1, 4), (1, "text", "dog", 1, 4), (1, "text", "the", 2, 4)]


def test_places_and_repeated_keys(spark):
    d = docs(spark, [(1, "b a b"), (1, "a a"), (2, "é zz é zz"), (None, "qq")])
    d = d.withColumn("text", F.replace(F.replace("text", F.lit("a"), F.lit("aa")), F.lit("b"), F.lit("bb")))
    rows, lengths = kept_index._postings(d, "id", ["text"])
    got = {(r["id"], r["term"]): (r["tf"], r["places"]) for r in rows.collect()}
    assert got == {(1, "bb"): (2, [0, 2]), (1, "aa"): (3, [0, 1, 1]), (2, "zz"): (2, [0, 1]), (None, "qq"): (1, [0])}
    assert {(r["id"], r["term"]): r["tf"] for r in search.postings(d, "id", ["text"]).collect()}[1, "aa"] == 3


def test_counted_against_plain_counts(spark):
    rows = spark.range(1000).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 40), lambda i: F.when((F.col("id") + i) % 5 == 0, "").otherwise(F.concat(F.lit("t"), F.col("id") * i % 7))).alias("terms"))
    plain = rows.select("id", F.size(F.filter("terms", lambda t: t != "")).alias("length"), F.posexplode("terms").alias("at", "term")).where("term <> ''")
    plain = plain.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("at")).alias("places"))
    key = lambda df: sorted(map(str, df.select("id", "term", "tf", "length", "places").collect()))
    assert key(search.counted(rows, ["id"])) == key(plain)
