"""Tables of the index: upserts, removal, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import percent

BUCKETS = 64


def bucket(path: str = "path", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def write(df: DataFrame, table: str, path_column: str, buckets: int = BUCKETS, rows_per_task: int = 1_000_000) -> None:
    """Write rows under the bucket of their file, in place of those buckets' rows; a bucket with many rows is written by several tasks."""
    rows = df.withColumn("bucket", bucket(path_column, buckets))
    tasks = max(1, -(-df.count() // (buckets * rows_per_task)))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(tasks))) if tasks > 1 else rows.repartition("bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)


def replace_files(stored: DataFrame, new: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    """``stored`` without the rows of ``paths`` (path), plus ``new``: clears and indexes files anew."""
    gone = paths.select(F.col("path").alias(column)).distinct()
    return stored.join(gone, column, "left_anti").unionByName(new, allowMissingColumns=True)


def remove_workspace(stored: DataFrame, root: str, column: str) -> DataFrame:
    """Rows that don't lie below the directory ``root``; siblings whose names begin alike stay."""
    return stored.where(~F.startswith(column, F.lit(root.rstrip("/") + "/")))


def statistics(symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (symbols, files, relationships)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(symbols, "symbols").join(count(files, "files"), F.lit(True)).join(count(edges, "relationships"), F.lit(True))


def workspace_statistics(symbols: DataFrame, root: str) -> DataFrame:
    """One row (symbols, files) of what lies below ``root``."""
    inside = symbols.where(F.startswith("file_path", F.lit(root.rstrip("/") + "/")))
    return inside.agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))


def by(symbols: DataFrame, column: str) -> DataFrame:
    return symbols.groupBy(column).agg(F.count("*").alias("n"))


def read(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop("bucket")


def record_workspaces(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table of workspaces (path, last_indexed, ...) with each path's latest row of both."""
    rows = stored.unionByName(new, allowMissingColumns=True)
    by = F.struct("last_indexed", *[c for c in rows.columns if c not in ("path", "last_indexed")])
    return rows.groupBy("path").agg(F.max_by(F.struct(*rows.columns), by).alias("v")).select("v.*")


def list_workspaces(workspaces: DataFrame, limit: int = 50) -> DataFrame:
    """Workspaces, last indexed first."""
    return workspaces.orderBy(F.desc("last_indexed"), "path").limit(limit)


def edge_statistics(edges: DataFrame, late_after: int) -> DataFrame:
    """(kind, n, late, mean, best): how many edges of each kind there are, how many after a line, mean and best confidence."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("line") > late_after).alias("late"), F.avg("confidence").alias("mean"), F.max("confidence").alias("best"))


def distinct_keys(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, each once; columns are taken by their place."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def batch_outcome(results: DataFrame, ok: str = "ok") -> DataFrame:
    """One row (succeeded, failed, percent) of a batch of results."""
    counts = results.agg(F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"))
    return counts.withColumn("percent", percent(F.col("succeeded"), F.col("succeeded") + F.col("failed")))


def with_metadata(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with metadata, the JSON text of some columns; see metadata_of."""
    return rows.withColumn("metadata", F.to_json(F.struct(*columns)))


def metadata_of(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with the fields of metadata in place of its text."""
    return rows.withColumn("_m", F.from_json("metadata", schema)).select(*[c for c in rows.columns if c != "metadata"], "_m.*")
