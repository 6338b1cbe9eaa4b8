"""Structure and positions take one pass over the files and one shuffle of what is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import code_queries
from codeloom.operators import navigation, structure

FILES = "path string, language string, content string"


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_not_multiplied_or_broadcast(spark):
    """A probe is one row of one shuffle: neither a row for each level of bins nor part of a join, whose exploded side would count as small."""
    spans = spark.range(10).select(F.lit("f").alias("file"), "id", F.col("id").alias("start_line"), (F.col("id") + 5).alias("end_line"), F.lit(0).alias("start_column"), F.lit(9).alias("end_column"), F.lit("class").alias("kind"))
    probes = spark.range(10).select(F.col("id").alias("probe_id"), F.lit("f").alias("file"), F.col("id").alias("line"), F.lit(1).alias("col"))
    for df in (navigation.containing(probes, spans, "file", unique=True), navigation.at_position(probes, spans, "file", unique=True)):
        text = plan(df)
        assert "Join" not in text and "Generate" not in text and text.count("Exchange") == 1
        assert df.count() == 10


def test_odd_places(spark):
    """An end before its start holds nothing; a probe without a column is held by the lines between; places of one probe count together."""
    spans = spark.createDataFrame([("f", 1, 5, 2, 0, 0, "class"), ("f", 2, 1, 9, 3, 3, "class"), ("g", 3, 1, 1, None, 5, "method"), ("g", 4, 3, 4, 2, None, "method")], "file string, id int, start_line int, end_line int, start_column int, end_column int, kind string")
    probes = [(1, "f", 5, 7), (2, "f", 1, None), (3, "f", 2, None), (4, "g", 1, 0), (5, "g", 4, 0), (6, "g", 3, 2), (7, "f", 5, 1), (7, "g", 1, 1), (8, None, 1, 1), (9, "f", None, 1)]
    probes = spark.createDataFrame(probes, "probe_id int, file string, line int, col int")
    got = {r["probe_id"]: r["id"] for r in navigation.containing(probes, spans, "file").collect()}
    assert got == {1: 2, 3: 2, 4: 3, 6: 4, 7: 3}


def test_symbols_shuffle_nothing(spark):
    files = spark.createDataFrame([("a.py", "python", "class A:\n    def f(self):\n        if x:\n            class B:\n                def g(self): pass\n")], FILES)
    assert "Exchange" not in plan(structure.symbols(files))
    got = {r["name"]: (r["parent_name"], r["depth"], r["kind"]) for r in structure.nested_symbols(files).collect()}
    assert got == {"A": (None, 0, "class"), "f": ("A", 1, "method"), "B": ("f", 2, "class"), "g": ("B", 3, "method")}


def test_code_is_written_after_the_shuffle(spark, small):
    """Text of files isn't shuffled, and partitions of what it is written from aren't put together."""
    text = plan(code_queries.code_symbols(spark, small))
    assert "REPARTITION_BY_NUM" in text and "Scan parquet" in text and "Join" in text
    last = text[text.index("REPARTITION_BY_NUM"):]
    assert "class Order" not in last


def test_heads_are_read_once():
    class Counted:
        tries = 0
        search = lambda self, line: setattr(Counted, "tries", Counted.tries + 1)

    text = "class A {\n" + "  void f() {\n    return 0;\n  }\n" * 500 + "}\n"
    assert len(list(structure._rows("java", text, structure.Heads("java", [("class", Counted())])))) == 501
    assert Counted.tries == 3
