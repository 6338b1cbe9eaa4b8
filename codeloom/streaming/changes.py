"""Streams of file changes: debouncing, and incremental upserts of the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.text import glob_regex
from codeloom.sources import workspace


def change_kind(event: str = "event", exists: str = "exists"):
    """create, change or delete, from a raw rename or change event and whether the file is there."""
    return F.when((F.col(event) == "rename") & F.col(exists), "create").when(F.col(event) == "rename", "delete").when(F.col(event) == "change", "change")


def debounce(events: DataFrame, key: str, time: str, gap: str, order: str | None = None) -> DataFrame:
    """The last event of each burst: those with no event of the same key less than ``gap`` after them."""
    w = Window.partitionBy(key).orderBy(time, *([order] if order else []))
    following = F.lead(time).over(w)
    return events.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= F.col(time) + F.expr(f"interval {gap}"))).drop("_next")


def debounce_stream(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """The same on a stream: (key, start, end, n, last), one row for each burst, once the watermark has passed it."""
    value = F.struct(*[F.col(c) for c in events.columns])
    order = F.struct(time, *[c for c in events.columns if c != time])  # of events at one time the largest
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.max_by(value, order).alias("last")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "last")


def last_of_each(events: DataFrame, key: str, time: str) -> DataFrame:
    """One event for each key, the last."""
    value = F.max_by(F.struct(*[F.col(c) for c in events.columns]), F.struct(time, *[c for c in events.columns if c not in (key, time)]))
    return events.groupBy(key).agg(value.alias("v")).select("v.*")


def upsert_stream(changes: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``apply`` on each micro-batch of ``changes`` until all that is there now is worked off."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_changes(stored: DataFrame, changes: DataFrame, key: str = "path", order: str | None = None) -> DataFrame:
    """The file table after a batch of changes (key, type, hash, ...): deleted files go, others are replaced if their hash differs.

    Of several changes of a key the last by ``order`` counts; among equal ones, or without ``order``, that which is
    last by all columns. Changes without a type are changes of contents.
    """
    typed = changes if "type" in changes.columns else changes.withColumn("type", F.lit("change"))
    by = F.struct(*([order] if order else []), *[c for c in typed.columns if c not in (key, order)])
    last = typed.groupBy(key).agg(F.max_by(F.struct(*typed.columns), by).alias("v")).select("v.*")
    known = stored.select(key, F.col("hash").alias("_h"))
    last = last.join(known, key, "left").where((F.col("type") == "delete") | ~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")
    kept = stored.join(last.select(key), key, "left_anti")
    new = last.where("type <> 'delete'")
    return kept.unionByName(new.select(*[c for c in stored.columns if c in new.columns]), allowMissingColumns=True)


def watch(spark: SparkSession, root: str, glob: str | None = None, ignored: tuple[str, ...] = (), per_batch: int = 1000) -> DataFrame:
    """A stream of the source files under ``root`` as they appear or are written anew: (path, language, last_modified, size, hash, content, type).

    Files of unknown languages, binary ones and those in skipped directories or under one of the ``ignored`` globs are
    passed over. A file source doesn't see deletions: these come as rows of type delete from a table of events.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch)
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    rows = workspace.source_files(found, root)
    for g in ignored:
        rows = rows.where(~F.col("path").rlike(glob_regex(g)))
    return rows.withColumn("type", F.lit("change"))
