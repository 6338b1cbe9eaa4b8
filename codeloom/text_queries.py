"""Queries of the maintained full-text index over the documents, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog import query
from codeloom.functions import diff
from codeloom.operators import kept_index, search
from codeloom.operators.staging import folder
from codeloom.plans import canonical as C

_kept: dict[tuple[str, str], str] = {}
_KEEP = "doc_id % 7 <> 3"


def _index(spark: SparkSession, d: str) -> str:
    """An index of the documents that was made in three generations: most, then the others and some again, then without one in seven."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _kept:
        docs, path = C.table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text"), folder(spark)
        kept_index.create(docs.where("doc_id % 4 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" the old text"))).otherwise(F.col("text"))), "doc_id", ["text"], path)
        kept_index.update(spark, path, docs.where("doc_id % 4 = 0 or doc_id % 10 = 1"), "doc_id", ["text"])
        kept_index.update(spark, path, None, "doc_id", ["text"], gone=docs.where(f"not ({_KEEP})").select("doc_id"))
        _kept[key] = path
    return _kept[key]


_POSTINGS = rf"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\W]+'), lambda x: length(x) > 1) AS t FROM documents WHERE doc_id IS NOT NULL AND {_KEEP}),
    p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t), i AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY doc_id, term),
    n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), df AS (SELECT term, count(*) AS df FROM i GROUP BY term)"""
_SCORE = f"ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / n.a))"


@query(f"WITH {_POSTINGS} SELECT doc_id, round(sum({_SCORE}), 6) AS score FROM i JOIN df USING (term), n WHERE term IN ('the', 'and', 'eau', 'ou') GROUP BY doc_id")
def kept_search(spark: SparkSession, d: str) -> DataFrame:
    return kept_index.search(spark, _index(spark, d), "doc_id", "the and eau ou").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_POSTINGS}, w AS (SELECT term, CASE WHEN term = 'thion' THEN 1.0 WHEN starts_with(term, 'thion') THEN 0.75 * 5 / length(term) ELSE 0.45 END AS w FROM df WHERE starts_with(term, 'thion') OR levenshtein(term, 'thion') <= 1)
    SELECT doc_id, round(sum(w * {_SCORE}), 6) AS score FROM i JOIN df USING (term) JOIN w USING (term), n GROUP BY doc_id""")
def kept_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """By beginning and within one edit, from the deletion neighbourhood."""
    return kept_index.search(spark, _index(spark, d), "doc_id", "thion", prefix=True, fuzzy=0.2).select("doc_id", F.round("score", 6).alias("score"))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\W]+'), lambda x: length(x) > 1) AS t FROM documents WHERE doc_id IS NOT NULL AND {_KEEP}),
    p AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS at FROM t) SELECT a.doc_id, count(*) AS n FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.at = a.at + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id""")
def kept_phrase(spark: SparkSession, d: str) -> DataFrame:
    return kept_index.phrase(spark, _index(spark, d), "doc_id", "Of the")


@query(rf"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\W]+'), lambda x: length(x) > 1)) AS INTEGER) AS length FROM documents WHERE doc_id IS NOT NULL AND {_KEEP}")
def kept_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents that count, and their terms."""
    return kept_index.current_lengths(spark, _index(spark, d), "doc_id")


@query(r"""SELECT doc_id, len(list_filter(l, lambda x: contains(x, 'th'))) AS removed, len(list_filter(l, lambda x: contains(x, 'th'))) + 1 AS added, true AS rebuilt
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'TH')) x""")
def text_diff(spark: SparkSession, d: str) -> DataFrame:
    """Lines that an edit of each document removes and adds, and whether the hunks are a way from one to the other."""
    docs = C.table(spark, d, "documents").where("text is not null and not contains(text, 'TH')").select("doc_id", "text")
    rows = docs.withColumn("new", F.concat(F.replace("text", F.lit("th"), F.lit("TH")), F.lit("\nan added TH line")))
    rows = rows.withColumn("h", diff.line_hunks(F.col("text"), F.col("new")))
    count = lambda side: F.aggregate("h", F.lit(0), lambda n, x: n + F.size(x[side])).cast("long")
    lines = F.size(F.split("text", "\n")) - count("removed") + count("added") == F.size(F.split("new", "\n"))
    return rows.select("doc_id", count("removed").alias("removed"), count("added").alias("added"), lines.alias("rebuilt"))
