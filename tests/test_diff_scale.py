"""Differences hold the texts of few rows at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.functions import diff


def test_batches_of_texts_are_small(spark, monkeypatch):
    """A partition of 1000 rows comes to the function in batches of BATCH_ROWS at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")

    def counted(old, new):
        hunk = {"old_start": len(old), "new_start": 0, "removed": [], "added": []}
        return pa.array([[hunk]] * len(old), pa.list_(pa.struct([("old_start", pa.int32()), ("new_start", pa.int32()), ("removed", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])))

    monkeypatch.setattr(diff, "_hunks", counted, raising=False)
    try:
        rows = spark.range(0, 1000, 1, 1).select(F.lit("a").alias("a"))
        sizes = [r["n"] for r in rows.select(diff.line_hunks(F.col("a"), F.col("a"))[0]["old_start"].alias("n")).collect()]
        assert len(sizes) == 1000 and max(sizes) <= diff.BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def test_hunks_as_one_array():
    """As hunks_of gives them, with empty, equal and null texts."""
    old, new = ["a\nb\nc", None, "", "x", "p\nq", None], ["a\nB\nc\nd", "n", "", "x", None, None]
    got = diff._hunks(pa.array(old, pa.string()), pa.array(new, pa.string())).to_pylist()
    assert got == [diff.hunks_of(x, y) for x, y in zip(old, new, strict=True)]
