"""Windows of lines, scopes, and edits of texts as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import folded


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def window(text: Column, line: Column | int, size: int = 10) -> Column:
    """The lines around ``line`` (from 1), size / 2 on each side, within the text."""
    lines = lines_of(text)
    at = F.lit(line) if isinstance(line, int) else line
    first = F.greatest(F.lit(1), at - size // 2)
    last = F.least(F.size(lines), at + size // 2)
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")


def scope_depth(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, depth): how many braces are open after each line.

    A file's lines stay in one row, so the running sum needs no shuffle and no window.
    """
    delta = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("{"))) - (F.char_length(x) - F.char_length(F.replace(x, F.lit("}"))))
    deltas = F.transform(lines_of(F.col(text)), delta)
    sums = F.aggregate(deltas, F.array().cast("array<int>"), lambda acc, d: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + d)))
    rows = files.select(key, F.posexplode(F.when(F.size(deltas) <= 200, sums)).alias("i", "depth"))
    long = files.where(F.size(lines_of(F.col(text))) > 200).select(key, F.posexplode(deltas).alias("i", "d"))
    running = F.sum("d").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.unionByName(long.select(key, "i", running.cast("int").alias("depth"))).select(key, (F.col("i") + 1).alias("line"), "depth")


def symbol_context(text: Column, start: Column, end: Column) -> Column:
    """The lines of a symbol (from 1) with three before and two after, within the text."""
    lines = lines_of(text)
    first = F.greatest(F.lit(1), start - 3)
    last = F.least(F.size(lines), end + 2)
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")


# Lines that import, by language; the first group is what they import.
IMPORTS = {
    "javascript": r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]""",
    "typescript": r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]""",
    "python": r"^\s*(?:from|import)\s+([\w.]+)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)",
    "kotlin": r"^\s*import\s+([\w.*]+)",
    "c_sharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)",
    "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)",
    "php": r"^\s*(?:use|require|require_once|include)\s*\(?['\"]?([\w./\\]+)",
    "swift": r"^\s*import\s+(\w+)",
    "dart": r"^\s*import\s+['\"]([^'\"]+)",
}


def imports(files: DataFrame) -> DataFrame:
    """(path, line, target) of the lines that import in ``files`` (path, language, content)."""
    lines = files.select("path", "language", F.posexplode(lines_of(F.col("content"))).alias("i", "raw"))
    found = F.coalesce(*[F.when(F.col("language") == k, F.regexp_extract("raw", p, 1)) for k, p in IMPORTS.items()], F.lit(""))
    return lines.select("path", (F.col("i") + 1).alias("line"), found.alias("target")).where("target <> ''")


def diff_preview(old: Column, new: Column) -> Column:
    """Both texts under headings; equal texts give an empty preview."""
    return F.when(old == new, "").otherwise(F.concat(F.lit("--- Original\n"), old, F.lit("\n+++ Modified\n"), new))


def insert_lines(text: Column, line: int, new: str) -> Column:
    """``new`` before ``line`` (from 1)."""
    lines = lines_of(text)
    return F.array_join(F.concat(F.slice(lines, 1, line - 1), F.lit(new.split("\n")), F.slice(lines, F.lit(line), F.greatest(F.lit(0), F.size(lines) - line + 1))), "\n")


def replace_lines(text: Column, first: int, last: int, new: str | None) -> Column:
    """``new`` (nothing, if None) in place of the lines from ``first`` to ``last``; a text with fewer than ``first`` lines stays."""
    lines = lines_of(text)
    rest = F.slice(lines, F.lit(last + 1), F.greatest(F.lit(0), F.size(lines) - last))
    middle = [F.lit(new.split("\n"))] if new is not None else []
    return F.when(F.size(lines) < first, text).otherwise(F.array_join(F.concat(F.slice(lines, 1, first - 1), *middle, rest), "\n"))


def delete_lines(text: Column, first: int, last: int) -> Column:
    return replace_lines(text, first, last, None)


def search_replace(files: DataFrame, text: str, old: str, new: str) -> DataFrame:
    """``files`` with text changed, n_replaced and n_lines_changed; the search is for the literal, and so is the replacement."""
    n = F.when(F.lit(old == ""), 0).otherwise(F.regexp_count(F.col(text), F.lit(re.escape(old) if old else "$^")))
    hit = F.lit(False) if not old else F.contains(F.col(text), F.lit(old))
    lines = F.size(F.filter(lines_of(F.col(text)), lambda x: F.contains(x, F.lit(old)))) if old and "\n" not in old else F.when(hit, n).otherwise(0)
    return files.withColumn("n_replaced", n).withColumn("n_lines_changed", lines).withColumn(text, F.replace(F.col(text), F.lit(old), F.lit(new)) if old else F.col(text))


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ts", ".js", ".tsx", ".jsx")) -> DataFrame:
    """``imports`` (path, target: relative) with resolved, the first existing candidate file, or null; ``.`` and ``..`` are folded."""
    base = folded(F.concat(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), F.col("target")))
    options = F.array(*[F.concat(base, F.lit(x)) for x in ("", *extensions, *[f"/index{e}" for e in extensions])])
    rows = imports.withColumn("_id", F.xxhash64("path", "target")).select("*", F.posexplode(options).alias("_i", "_c"))
    known = files.select(F.col("path").alias("_c")).distinct()
    best = rows.join(known, "_c").groupBy("_id").agg(F.min_by("_c", "_i").alias("resolved"))
    return imports.withColumn("_id", F.xxhash64("path", "target")).join(best, "_id", "left").drop("_id")
