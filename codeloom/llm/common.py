"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold at least one row in this many are handled apart; there can be no more of them than this.
HEAVY_ONE_IN = 1000
#: Largest number of narrow rows (some 60 bytes) that is ever broadcast after a count.
BROADCAST_ROWS = 500_000
#: Rows of text in one Arrow batch.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small: rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int) -> AbstractContextManager:
    """Arrow batches of at most ``rows`` rows in what runs inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


_forget: list[Callable[[], None]] = []


def remembers(forget: Callable[[], None]) -> None:
    """Name what empties a memory that an operator keeps between the tasks of a worker."""
    _forget.append(forget)


def give_back(keep: bool = False) -> None:
    """Return freed memory to the system at the end of a task: a worker goes on to other stages, and its freed memory would count beside theirs.

    What operators remember between tasks goes too, unless the task is of an operator that does so (``keep``).
    """
    if not keep:
        for forget in _forget:
            forget()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one only where that is unset and master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application's tables."""
    return f"{shared_dir(spark)}/codeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete what lies under ``path``, by the file system that it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files behind the table are removed once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        if path := _paths.pop(t, None):
            remove_path(t.sparkSession, path)


def remove_staged(spark: SparkSession) -> None:
    """Delete all tables that this application has staged: for when its results are written elsewhere."""
    remove_path(spark, f"{shared_dir(spark)}/codeloom/{spark.sparkContext.applicationId}")


def join_back(facts: DataFrame, summary: DataFrame, keys: list[str], values: list[str], count: str, total: int, row: Column) -> DataFrame:
    """Left-join one summary row per key onto ``facts`` without sending a hot key to one task.

    ``summary`` has one row for each key with ``count``, its rows in facts, which has ``total`` rows. At most
    HEAVY_ONE_IN keys can hold one row in HEAVY_ONE_IN, so those are broadcast; facts resolved that way are then
    spread over all tasks by ``row``, any expression that differs from row to row. keys[0] must be a long.
    """
    wanted = [*keys, F.struct(*values).alias("_v")]
    heavy = summary.where(F.col(count) * HEAVY_ONE_IN >= total).select(*wanted).withColumnRenamed("_v", "_hv")
    light = summary.where(F.col(count) * HEAVY_ONE_IN < total).select(*wanted).withColumnRenamed("_v", "_lv")
    light = light.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_lv")
    out = facts.join(F.broadcast(heavy), keys, "left").withColumn("_k", F.when(F.col("_hv").isNull(), F.col(keys[0])).otherwise(F.xxhash64(row)))
    on = F.col("_k") == F.col(f"_s_{keys[0]}")
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"_s_{k}"))
    out = out.join(light, on, "left").withColumn("_w", F.coalesce("_hv", "_lv"))
    for v in values:
        out = out.withColumn(v, F.col(f"_w.{v}"))
    return out.drop("_hv", "_lv", "_k", "_w", *[f"_s_{k}" for k in keys])


def keep_rows(df: DataFrame, wanted: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (or, by left_anti, isn't) in ``wanted``, a staged table of unique keys: broadcast if its count allows."""
    small = wanted.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(wanted) if small else wanted, key, how)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
