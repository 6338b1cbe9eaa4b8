"""A workspace's index in one call: files, symbols, types, relations and the full-text index, kept up to date by hashes.

A folder holds versions; each is complete, and counts once its counts are written, so searches never see half of one.
A version takes the symbols of files that didn't change from the one before. Relations are worked out anew, as a
changed file may change what names mean in others. The full-text index gets a generation of the changed files' symbols.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import extract, kept_index, relations, structure
from codeloom.operators.staging import stage
from codeloom.sources import workspace

FIELDS = ["name", "signature", "doc_comment"]


def version(spark: SparkSession, path: str) -> int | None:
    """The latest version that counts, if there is one."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(top):
        return None
    names = [s.getPath().getName() for s in system.listStatus(top)]
    done = [int(n.partition("=")[2]) for n in names if n.startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/counts/_SUCCESS"))]
    return max(done, default=None)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """files, symbols, types, relations or counts of the latest version."""
    return spark.read.parquet(f"{path}/version={version(spark, path)}/{table}")


def index_workspace(spark: SparkSession, source: str | DataFrame, path: str) -> DataFrame:
    """Index the files under the folder ``source``, or its rows (path, language, hash, content, ...), under ``path``.

    One row is returned: (files, new, changed, removed, symbols, relations). The first call makes the index, later ones
    read the structure of new and changed files only. Files that are no longer there leave it. Of rows that repeat a path
    the one with the largest hash counts; rows without a path or content are left out.
    """
    files = workspace.scan(spark, source) if isinstance(source, str) else source
    files = files.where("path is not null and content is not null")
    files = stage(files.groupBy("path").agg(F.max_by(F.struct(*files.columns), F.struct("hash", "content")).alias("v")).select("v.*"))
    last = version(spark, path)
    stored = read(spark, path, "files") if last is not None else files.where(F.lit(False))
    marked = stage(workspace.changed(files, stored.select("path", "hash")))
    fresh = marked.where("status <> 'same'").select("path", "language", "content")
    gone = stage(stored.select("path").join(files.select("path"), "path", "left_anti"))
    symbols = structure.symbols(fresh)
    touched = stage(fresh.select(F.col("path").alias("file_path")).unionByName(gone.select(F.col("path").alias("file_path"))))
    if last is not None:
        before = read(spark, path, "symbols")
        symbols = before.join(touched, "file_path", "left_anti").select(*symbols.columns).unionByName(symbols)
    here = f"{path}/version={0 if last is None else last + 1}"
    files.drop("content").write.parquet(f"{here}/files")
    symbols.write.parquet(f"{here}/symbols")
    symbols = spark.read.parquet(f"{here}/symbols")
    extract.inferred_types(symbols).write.parquet(f"{here}/types")
    relations.relations(files.select("path", "language", "content"), symbols).write.parquet(f"{here}/relations")
    text = f"{path}/text"
    rows = symbols.select("id", "file_path", *FIELDS).dropDuplicates(["id"])
    if last is None:
        kept_index.create(rows, "id", FIELDS, text)
    else:
        dropped = before.join(touched, "file_path", "left_semi").select("id")
        kept_index.update(spark, text, rows.join(touched, "file_path", "left_semi"), "id", FIELDS, gone=dropped)
    count = lambda table: spark.read.parquet(f"{here}/{table}").count()
    status = {r["status"]: r["n"] for r in marked.groupBy("status").agg(F.count("*").alias("n")).collect()}
    row = (count("files"), status.get("new", 0), status.get("changed", 0), gone.count(), count("symbols"), count("relations"))
    counts = spark.createDataFrame([row], "files long, new long, changed long, removed long, symbols long, relations long")
    counts.coalesce(1).write.parquet(f"{here}/counts")
    return spark.read.parquet(f"{here}/counts")


def search(spark: SparkSession, path: str, query: str, limit: int = 50, fuzzy: float = 0.2, **options: object) -> DataFrame:
    """Symbols of a workspace for which every term of the query matches, best first, from the kept full-text index."""
    hits = kept_index.search(spark, f"{path}/text", "id", query, all_terms=True, prefix=True, fuzzy=fuzzy, **options)
    return read(spark, path, "symbols").join(hits.select("id", "score"), "id").orderBy(F.desc("score"), "id").limit(limit)
