"""Places are looked up where the text is read: as by symbols that are written and shuffled first."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from codeloom import code_queries
from codeloom.operators import extract, lexing, navigation, structure

FILES = "path string, language string, content string"
TEXTS = {
    "java": "class A {\n  int x = 1;\n  void f() {\n    if (a) { }\n  }\n  A() { }\n  class B { void g() {} void h() {\n } }\n}\nclass C {}\n",
    "python": "class A:\n  def f(self): pass\n  def g(self):\n    x = 1\n    def h():\n      pass\nX = 2\n\nclass B: pass\n",
    "ruby": "module M\n  class A\n    def f; end\n    def g\n      if x\n        1\n      end\n    end\n  end\nend\n",
    "typescript": "class A {\n  constructor() { }\n  m(\n   a) {\n    return 1 }\n}\nfunction f() { }\nexport const g = () => {\n}\n",
    "unknown": "class A:\n", "go": "import (\n\"a\"\n)\nfunc f() {\n}\n",
}


def _tables(spark):
    files = [(f"{n}{i}", n, text) for n, text in TEXTS.items() for i in range(3)] + [("null", "java", None), (None, "java", TEXTS["java"]), ("none", None, TEXTS["java"])]
    rng = random.Random(3)
    probes = [(i, rng.choice(files)[0], rng.choice([None, *range(-1, 14)]), rng.choice([None, *range(-1, 12)])) for i in range(1500)] + [(7, "java0", 4, 3), (8, "gone", 1, 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(probes, "probe_id int, file_path string, line int, col int")


def test_as_by_symbols(spark):
    files, probes = _tables(spark)
    symbols = structure.symbols(files).withColumn("id", F.struct("start_line", "name"))
    kinds = ("function", "method", "constructor", "class", "interface")
    for got, want in (
        (navigation.located(files, probes), navigation.at_position(probes, symbols, "file_path").select("probe_id", "id.name", "id.start_line", "size")),
        (navigation.located(files, probes, containers=kinds).drop("size"), navigation.containing(probes, symbols.where(F.col("kind").isin(*kinds))).select("probe_id", "id.name", "id.start_line")),
    ):
        rows = sorted(tuple(r) for r in got.collect())
        assert rows == sorted(tuple(r) for r in want.collect()) and len(rows) > 300 and got.columns == want.columns


def test_one_shuffle_of_what_text_is_written_from(spark, small):
    """Probes meet their file in one shuffle, before its text is written; symbols leave no batch."""
    for query in (code_queries.code_position, code_queries.code_container):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
        before = plan[plan.index("MapInArrow"):]
        before = before[before.index("Exchange"):]
        assert "class Hidden" not in before and "Hidden" in plan


def test_one_file_with_most_probes_is_not_held(spark):
    """Probes stream past their file's spans: a batch has 256 rows, however many a file has."""
    files = spark.createDataFrame([("a", "java", TEXTS["java"])], FILES)
    probes = spark.range(20_000).select("id", F.lit("a").alias("file_path"), (F.col("id") % 12).alias("line"), F.lit(1).alias("col")).withColumnRenamed("id", "probe_id")
    got = navigation.located(files, probes, unique=True)
    assert got.count() == probes.where("line between 1 and 10").count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_statements_that_declare_nothing_leave_no_units():
    text = "class A {\n" + "  void f() {\n    g(1);\n    return 0;\n  }\n" * 50 + "}\n"
    heads = structure.Heads("java", [(k, re.compile(p, re.ASCII)) for k, p in extract.DECLARATIONS["java"]])
    assert len(structure._read("java", text, heads)[3]) == 51
    assert len(structure._read("java", text)[3]) == 151
    for language, decl in extract.DECLARATIONS.items():
        heads = structure.Heads(language, [(k, re.compile(p, re.ASCII)) for k, p in decl])
        for t in TEXTS.values():
            every = list(structure._nested(structure._rows(language, t, heads, structure._read(language, t))))
            assert list(structure._nested(structure._rows(language, t, heads))) == every
    known = lexing.Lines()
    assert known.put("x" * 401, 401, (1,)) == (1,) and not known
