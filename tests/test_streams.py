"""The folder source sees creation, change, deletion and renaming; debouncing by processing time."""

from __future__ import annotations

import time

import pytest

from codeloom.streaming import debouncing, folder_source


def test_folder_changes(spark, tmp_path):
    root, state = tmp_path / "root", tmp_path / "state"
    (root / "sub").mkdir(parents=True)
    (root / "node_modules").mkdir()
    folder_source.register(spark)
    stream = spark.readStream.format("folder_changes").option("path", str(root)).option("state", str(state)).option("extensions", ".py,.ts").option("maxSize", "100").load()
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, n: seen.extend((r["path"].removeprefix(str(root) + "/"), r["type"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()

    def settled():
        query.processAllAvailable()
        out = sorted(seen)
        seen.clear()
        return out

    try:
        (root / "a.py").write_text("1")
        (root / "sub" / "b.ts").write_text("2")
        (root / "c.md").write_text("3")
        (root / "big.py").write_text("x" * 200)
        (root / "node_modules" / "d.py").write_text("4")
        time.sleep(0.5)
        assert settled() == [("a.py", "create"), ("sub/b.ts", "create")]
        (root / "a.py").write_text("changed")
        (root / "sub" / "b.ts").rename(root / "sub" / "e.ts")
        time.sleep(0.5)
        assert settled() == [("a.py", "change"), ("sub/b.ts", "delete"), ("sub/e.ts", "create")]
        (root / "a.py").unlink()
        time.sleep(0.5)
        assert settled() == [("a.py", "delete")]
    finally:
        query.stop()


def test_differences():
    before, after = {"a": [1, 1], "b": [1, 1], "c": [1, 1]}, {"a": [1, 1], "b": [2, 1], "d": [3, 4]}
    assert folder_source.differences(before, after) == [("b", "change", 2, 1), ("c", "delete", None, None), ("d", "create", 3, 4)]
    assert folder_source.differences({}, {}) == []


@pytest.mark.parametrize("in_flight", [0, 60_000])
def test_debouncing(spark, tmp_path, in_flight):
    """Bursts over micro-batches give one event, the last; keys in flight are left alone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", debouncing.PROVIDER)
    source = tmp_path / "events"
    source.mkdir()

    def put(name, rows):
        spark.createDataFrame(rows, "path string, type string, n long").coalesce(1).write.mode("append").json(str(source))

    put("0", [("a", "create", 1), ("b", "create", 1)])
    events = spark.readStream.schema("path string, type string, n long").json(str(source))
    seen = []
    query = debouncing.debounce_stream(events, "path", quiet=4000, in_flight=in_flight).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="300 milliseconds").start()
    try:
        time.sleep(1)  # processAllAvailable would wait for ever: timers make empty batches
        put("1", [("a", "change", 2)])
        time.sleep(1)
        put("2", [("a", "change", 3)])
        deadline = time.time() + 60
        while len(seen) < 2 and time.time() < deadline:
            time.sleep(0.3)
        assert sorted(seen) == [("a", "change", 3), ("b", "create", 1)]
        put("3", [("a", "change", 4), ("c", "create", 5)])
        while len(seen) < (4 if not in_flight else 3) and time.time() < deadline:
            time.sleep(0.3)
        assert sorted(seen)[-1] == ("c", "create", 5) and (("a", "change", 4) in seen) == (not in_flight)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
