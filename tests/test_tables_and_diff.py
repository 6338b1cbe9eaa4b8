"""Table functions in SQL, and line differences against dynamic programming."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codeloom.functions import diff, tables


def test_symbols_in_sql(spark):
    files = [("a/b.py", "class A:\n    def f(self):\n        if x:\n            def g(): pass\n"), ("c.own", "thing T\n"), ("d.txt", "class X"), (None, None)]
    spark.createDataFrame(files, "path string, content string").createOrReplaceTempView("udtf_files")
    tables.register(spark, {"own": [("class", r"^thing +(\w+)")]}, {"own": "own"}, prefix="t_")
    rows = spark.sql("SELECT path, s.name, s.kind, s.parent, s.start_line FROM udtf_files, LATERAL t_symbols(path, content) s").collect()
    assert sorted(map(tuple, rows)) == [("a/b.py", "A", "class", None, 1), ("a/b.py", "f", "method", "A", 2), ("a/b.py", "g", "method", "f", 4), ("c.own", "T", "class", None, 1)]
    with pytest.raises(AnalysisException, match="unknown language"):
        spark.sql("SELECT * FROM t_symbols('a', 'b', 'nolang')").collect()
    assert [tuple(r) for r in spark.sql("SELECT * FROM t_stems('Connected users, a')").collect()] == [(0, "connected", "connect"), (1, "users", "user")]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fewest_changes():
    rng = random.Random(7)
    for _ in range(1500):
        old, new = ("\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(2))
        hunks = diff.hunks_of(old, new)
        assert diff.applied(old, hunks) == new
        a, b = old.split("\n"), new.split("\n")
        assert sum(len(h["removed"]) + len(h["added"]) for h in hunks) == len(a) + len(b) - 2 * longest(a, b)


def test_hunks_column(spark):
    rows = [("a\nb\nc", "a\nx\nc\nd"), (None, ""), ("same", "same"), (None, "new")]
    got = spark.createDataFrame(rows, "o string, n string").select(diff.line_hunks(F.col("o"), F.col("n")).alias("h")).collect()
    assert [[tuple(h) for h in r["h"]] for r in got] == [[(2, 2, ["b"], ["x"]), (4, 4, [], ["d"])], [], [], [(1, 1, [""], ["new"])]]
