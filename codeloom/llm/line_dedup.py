"""Removal of repeated passages by overlapping windows of three lines.

Lines are compared with white space folded; blank ones are passed over and never removed. All windows of three
consecutive lines are hashed (128 bits) and counted over all documents. A window's first occurrence is that with the
smallest doc_id, then the smallest place; later occurrences cover lines, and covered lines go, but for those that
overlap the window's own first occurrence. Every line that goes has an equal one at an earlier place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, join_back, stage_table, text_of

LINES = 3


def _windows(lines: Column) -> Column:
    """Array of (a, b, at): two hashes of each window and the line numbers it covers."""
    folded = F.transform(lines, lambda x, i: F.struct(F.trim(F.regexp_replace(x, r"\s+", " ")).alias("t"), i.alias("i")))
    full = F.filter(folded, lambda x: x.t != "")
    hashed = F.transform(full, lambda x: F.struct(F.xxhash64(x.t).alias("a"), F.xxhash64(F.lit("line"), x.t).alias("b"), x.i.alias("i")))
    part = lambda h, i, name: [F.get(h, i + F.lit(j)).getField(name) for j in range(LINES)]
    starts = lambda h: F.when(F.size(h) >= LINES, F.sequence(F.lit(0), F.size(h) - LINES)).otherwise(F.array().cast("array<int>"))
    # one-element array: the hashes are worked out once
    return F.flatten(F.transform(F.array(hashed), lambda h: F.transform(starts(h), lambda i: F.struct(F.xxhash64(*part(h, i, "a")).alias("a"), F.xxhash64(*part(h, i, "b")).alias("b"), F.array(*part(h, i, "i")).alias("at")))))


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, covered) of the documents that lose lines: their numbers, from 0, ascending."""
    found = docs.where("doc_id is not null").select("doc_id", F.explode(_windows(F.split(text_of(docs), "\n"))).alias("w"))
    found = stage_table(found.select("doc_id", "w.a", "w.b", "w.at"), "windows")
    place = F.struct("doc_id", "at")
    groups = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    marked = join_back(found, groups, ["a", "b"], ["first"], "c", max(1, found.count()), F.struct("doc_id", F.get("at", 0)))
    # only what overlaps the window's own first occurrence stays; all else has an equal at an earlier place
    own = F.when(F.col("first.doc_id") == F.col("doc_id"), F.col("first.at")).otherwise(F.array().cast("array<int>"))
    lost = marked.where(F.col("first") != place).select("doc_id", F.array_except("at", own).alias("lost")).where("size(lost) > 0")
    covered = lost.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lost")))).alias("covered"))
    covered = stage_table(covered, "covered")
    discard(found)
    return covered


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with repeated passages removed from text, plus n_lines and n_removed.

    Columns of ``docs`` named n_lines or n_removed give way to the operator's own; any others are kept. n_chars, if
    there is such a column, follows the new text. Null texts stay null and have no lines; a text that loses all its
    lines becomes empty. Rows without a doc_id are kept as they are and not compared; rows that repeat a doc_id count
    as one document: windows at the same place in them aren't later occurrences of each other, and each row loses the
    lines that any of them loses. Empty input: no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    covered = covered_lines(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*names).alias("row"))
    # one plan at all sizes: a table of places that is small as a file may be large in memory
    both = rows.join(covered.hint("merge"), F.col("row.doc_id") == F.col("id"), "left").select("row", "covered")
    # one-element array: the text is split once, and kept lines are looked up by number
    kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered"))
    split = lambda lines: F.array_join(F.transform(kept(lines), lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(F.get(F.transform(F.array(F.split("row.text", "\n")), split), 0))
    n_lines = F.coalesce(F.regexp_count("row.text", F.lit("\n")) + 1, F.lit(0))
    both = both.select("row", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")}
    return both.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in names], "n_lines", "n_removed")
