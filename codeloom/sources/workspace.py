"""Scanning workspaces of source files into DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import extension, glob_regex

# Languages and their file name extensions.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs"),
    "typescript": (".ts", ".tsx"),
    "css": (".css", ".scss", ".sass", ".less"),
    "html": (".html", ".htm"),
    "python": (".py", ".pyw"),
    "rust": (".rs",),
    "go": (".go",),
    "java": (".java",),
    "c_sharp": (".cs",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "ruby": (".rb",),
    "php": (".php",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "qmljs": (".qml", ".qmldir"),
    "vue": (".vue",),
    "razor": (".razor", ".cshtml"),
    "sql": (".sql", ".ddl", ".dml"),
    "zig": (".zig",),
    "dart": (".dart",),
    "bash": (".sh", ".bash", ".zsh"),
    "powershell": (".ps1", ".psm1", ".psd1"),
    "lua": (".lua",),
    "gdscript": (".gd",),
    "regex": (".regex",),
}
# Directories that are never entered, besides those that begin with a full stop.
SKIPPED = ("node_modules", ".git", ".vscode", "dist", "build", "coverage")
# Extensions of files that are binary whatever they hold.
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".woff", ".woff2", ".ttf", ".mp3", ".mp4")
MAX_FILE_SIZE = 5 * 1024 * 1024
SNIFFED = 1024


def language_of(path: Column, languages: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The language of a path's extension, or null. Pass a larger table to register more languages."""
    pairs = [F.lit(x) for name, exts in (languages or LANGUAGES).items() for ext in exts for x in (ext, name)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_skipped(path: Column, root: str) -> Column:
    """Whether a directory between ``root`` and the file is never entered."""
    inside = F.slice(F.split(F.substring(path, len(root) + 1, 1 << 30), "/"), 1, F.greatest(F.lit(0), F.size(F.split(F.substring(path, len(root) + 1, 1 << 30), "/")) - 1))
    return F.exists(inside, lambda d: d.isin(*SKIPPED) | F.startswith(d, F.lit(".")))


def is_binary(content: Column, path: Column | None = None) -> Column:
    """A zero byte among the first SNIFFED, or an extension of binary files; empty files are text."""
    zero = F.coalesce(F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00")), F.lit(False))
    return zero if path is None else zero | F.lower(extension(path)).isin(*BINARY_EXTENSIONS)


def scan(spark: SparkSession, root: str, max_size: int = MAX_FILE_SIZE, glob: str | None = None, languages: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(path, language, last_modified, size, hash, content) of the source files under ``root``.

    Files of unknown languages, over ``max_size`` bytes, binary, or in skipped directories are left out, and so are
    empty ones, which Spark's reader doesn't list; files that vanish or can't be read are passed over.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return source_files(reader.load(root), root, max_size, languages)


def source_files(found: DataFrame, root: str, max_size: int = MAX_FILE_SIZE, languages: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The source files among rows of Spark's binary files, read from ``root`` at once or as a stream: see scan."""
    plain = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    rows = found.where(F.col("length") <= max_size).withColumn("path", plain).withColumn("language", language_of(F.col("path"), languages))
    rows = rows.where(F.col("language").isNotNull() & ~is_skipped(F.col("path"), base) & ~is_binary(F.col("content")))
    return rows.select("path", "language", F.col("modificationTime").alias("last_modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content"))


def grep(files: DataFrame, pattern: str, limit_per_file: int | None = None, limit: int | None = None, file_pattern: str | None = None, below: str | None = None) -> DataFrame:
    """(path, line, column, byte_column, text): lines of ``files`` (path, content) that the regular expression finds, from 1.

    byte_column counts the bytes of UTF-8 before the match. ``file_pattern`` is a glob of paths, ``below`` a directory.
    With a limit the first lines by path and line are given.
    """
    if file_pattern:
        files = files.where(F.col("path").rlike(glob_regex(file_pattern)))
    if below:
        files = files.where(F.startswith("path", F.lit(below.rstrip("/") + "/")))
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "raw"))
    hits = lines.where(F.col("raw").rlike(pattern)).withColumn("column", F.regexp_instr("raw", F.lit(pattern)))
    byte = F.octet_length(F.substring(F.col("raw"), F.lit(1), F.col("column") - 1)) + 1
    out = hits.select("path", (F.col("i") + 1).alias("line"), "column", byte.alias("byte_column"), F.trim("raw").alias("text"))
    if limit_per_file is not None:
        rank = F.row_number().over(Window.partitionBy("path").orderBy("line"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= limit_per_file).drop("_r")
    return out if limit is None else out.orderBy("path", "line").limit(limit)


def changed(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of ``found`` whose hash differs from that ``stored`` for their path, or that aren't stored: what to index anew."""
    known = stored.select(F.col("path").alias("_p"), F.col("hash").alias("_h"))
    out = found.join(known, F.col("path") == F.col("_p"), "left")
    return out.withColumn("status", F.when(F.col("_p").isNull(), "new").when(~F.col("hash").eqNullSafe(F.col("_h")), "changed").otherwise("same")).drop("_p", "_h")
