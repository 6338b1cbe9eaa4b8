"""Functions, extraction, edits, stores and streams on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import context, extract, navigation, search, store, vector_search
from codeloom.sources import workspace
from codeloom.streaming import changes


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, "getUserData a_b  x", T.simple_tokens) == ["getuserdata", "a_b"]
    assert set(one(spark, "getUserData", T.code_tokens)) == {"get", "user", "data", "getuserdata"}
    assert "promise<user>" in one(spark, "Promise<User>", T.code_tokens)
    terms = one(spark, "let x1 = 'str' + foo_bar; // note\n/* block */ Getter => 12 \"q\\\"r\" kebab-case", T.code_terms)
    assert set(terms) == {"x1", "foo_bar", "getter", "=>", "kebab-case", "kebab", "case"}
    assert one(spark, "'" + "a " * 50_000 + "'", T.code_terms) == []


def test_similarity_and_layers(spark):
    q = lambda c: T.name_similarity(c, F.lit("user"))
    assert one(spark, "USER", q) == 1.0 and one(spark, "UserService", q) == 0.8
    assert abs(one(spark, "usir", q) - 0.75) < 1e-9
    assert one(spark, "src/API/x.ts", T.layer) == "api" and one(spark, "x", T.layer) == "unknown"
    assert one(spark, "a/models/x", T.directory_layer) == "data"
    assert one(spark, "UserRepository", lambda c: T.pattern_tags(c, F.lit("class"))) == ["repository", "class"]
    assert one(spark, "a/b.test.ts", T.extension) == ".ts"
    assert one(spark, "a/node_modules/b/c.js", lambda c: c.rlike(T.glob_regex("**/node_modules/**")))
    assert T.like_literal("a_b%") == r"a\_b\%"
    assert one(spark, r"(?=a)[b]+|\p{L}", T.pattern_complexity) == 12  # 2 quantifiers, 6 brackets, a lookaround, a property, an alternative


def test_scan_and_delta(spark, tmp_path):
    for name, content in {"a.ts": "class A {}", "node_modules/b.ts": "x", ".git/c.ts": "x", "d/e.py": "def f(): pass", "bin.js": "a\0b", "n.txt": "x", "d.go": "package d"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(content)
    found = workspace.scan(spark, str(tmp_path))
    rows = {r["path"].removeprefix(str(tmp_path)): r["language"] for r in found.collect()}
    assert rows == {"/a.ts": "typescript", "/d/e.py": "python", "/d.go": "go"}
    stored = found.withColumn("hash", F.when(F.col("language") == "go", F.lit("old")).otherwise(F.col("hash"))).where("language <> 'python'")
    status = {r["language"]: r["status"] for r in workspace.changed(found, stored).collect()}
    assert status == {"typescript": "same", "python": "new", "go": "changed"}
    hits = workspace.grep(found, "c?l?ass|def").collect()
    assert sorted((r["line"], r["column"]) for r in hits) == [(1, 1), (1, 1)] or len(hits) == 2


SOURCES = [
    ("a.ts", "typescript", "export class Animal implements Named {\n  private name: string = 'x';\n  speak(): void {\n    helper();\n  }\n}\nexport interface Named {}\nfunction helper(): number { return 1; }\nconst f = (x) => x;\nimport { z } from './z';"),
    ("b.py", "python", "import os\nclass Dog(Animal):\n    def bark(self) -> str:\n        return run()\n\ndef run():\n    pass\nMAX = 3\n"),
    ("c.java", "java", "package a.b;\npublic class Cat extends Pet {\n    private int age = 1;\n    public void purr(int x) {\n    }\n}"),
    ("d.go", "go", "package main\nfunc (s *S) Run() error {\n}\nfunc main() {\n}\ntype S struct {\n}"),
    ("e.rs", "rust", "pub struct P;\ntrait Show {}\nimpl Show for P {}\npub fn go() -> i32 {\n}"),
    ("f.sql", "sql", "CREATE TABLE users (\n  id INTEGER,\n  name VARCHAR(9)\n);\nCREATE VIEW v AS SELECT 1;"),
    ("g.rb", "ruby", "module M\n  class A < B\n    attr_reader :x\n    def initialize\n    end\n    def go?\n    end\n  end\nend"),
    ("h.css", "css", ".card {\n  --main: red;\n}\n@keyframes spin {\n}"),
    ("i.vue", "vue", "<template>\n</template>\n<script>\nfunction setup() {\n}\n</script>"),
]


def test_extraction(spark):
    files = spark.createDataFrame(SOURCES, "path string, language string, content string")
    found = extract.symbols(files)
    got = {(r["file_path"], r["name"], r["kind"]) for r in found.collect()}
    for wanted in [("a.ts", "Animal", "class"), ("a.ts", "speak", "method"), ("a.ts", "helper", "function"), ("a.ts", "Named", "interface"), ("a.ts", "f", "function"), ("a.ts", "name", "property"), ("a.ts", "./z", "import"),
                   ("b.py", "Dog", "class"), ("b.py", "bark", "method"), ("b.py", "run", "function"), ("b.py", "MAX", "constant"), ("c.java", "Cat", "class"), ("c.java", "purr", "method"), ("c.java", "age", "property"),
                   ("d.go", "Run", "method"), ("d.go", "main", "function"), ("d.go", "S", "class"), ("e.rs", "P", "class"), ("e.rs", "go", "function"), ("f.sql", "users", "class"), ("f.sql", "name", "field"), ("f.sql", "v", "interface"),
                   ("g.rb", "initialize", "constructor"), ("g.rb", "go?", "method"), ("h.css", "--main", "property"), ("h.css", "spin", "function"), ("i.vue", "template", "class"), ("i.vue", "setup", "function")]:
        assert wanted in got, wanted
    types = {r["resolved_type"] for r in extract.inferred_types(found).collect()}
    assert {"str", "number", "i32", "int"} <= types
    edges = {(r["to_name"], r["kind"], r["to_id"] is not None) for r in extract.inheritance(files, found).collect()}
    assert {("Named", "implements", True), ("Animal", "extends", False), ("Pet", "extends", False), ("B", "extends", False), ("Show", "implements", True)} <= edges
    calls = extract.call_edges(files, found).join(found.select(F.col("id").alias("to_id"), "name"), "to_id").join(found.select(F.col("id").alias("from_id"), F.col("name").alias("caller")), "from_id")
    assert {(r["caller"], r["name"]) for r in calls.collect()} >= {("speak", "helper"), ("bark", "run")}


def test_every_language_has_rules():
    assert set(workspace.LANGUAGES) == set(extract.DECLARATIONS)


def test_edits(spark):
    text = "a\nb\nc\nd"
    assert one(spark, text, lambda c: context.insert_lines(c, 2, "x\ny")) == "a\nx\ny\nb\nc\nd"
    assert one(spark, text, lambda c: context.replace_lines(c, 2, 3, "x")) == "a\nx\nd"
    assert one(spark, text, lambda c: context.delete_lines(c, 4, 9)) == "a\nb\nc"
    assert one(spark, text, lambda c: context.window(c, 2, 2)) == "a\nb\nc" and one(spark, text, lambda c: context.window(c, 40, 2)) == ""
    files = spark.createDataFrame([("p/a.ts", "./b")], "path string, target string").withColumn("target", F.lit("b"))
    known = spark.createDataFrame([("p/b.js",), ("p/b/index.ts",)], "path string")
    assert context.resolve_imports(files, known).first()["resolved"] == "p/b.js"


def test_fuzzy_search(spark):
    rows = [("1", "User", "class", "typescript"), ("2", "userService", "variable", "typescript"), ("3", "fetchUser", "function", "javascript"), ("4", "get_user_data", "function", "python"), ("5", "usre", "x", "y")]
    symbols = spark.createDataFrame(rows, "id string, name string, kind string, language string").withColumn("file_path", F.lit("a"))
    got = [r["name"] for r in search.fuzzy_symbols(symbols, "User").collect()]
    assert got[0] == "User" and "userService" in got and "fetchUser" not in got
    assert search.fuzzy_symbols(symbols, "").collect() == []
    assert [r["name"] for r in search.fuzzy_symbols(symbols, "user", language="typescript", limit=1).collect()] == ["User"]


def test_store(spark, tmp_path):
    table = str(tmp_path / "files")
    store.write(spark.createDataFrame([("a/x", 1), ("a/y", 2), ("ab/z", 3)], "path string, v int"), table, "path")
    stored = store.read(spark, table)
    assert store.remove_workspace(stored, "a", "path").collect()[0]["path"] == "ab/z"
    new = store.replace_files(stored, spark.createDataFrame([("a/x", 9)], "path string, v int"), spark.createDataFrame([("a/x",)], "path string"), "path")
    assert sorted(r["v"] for r in new.collect()) == [2, 3, 9]


def test_stream_upserts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, hash string").write.parquet(target + "/0")
    spark.createDataFrame([("a", "h9", "change"), ("b", "", "delete"), ("c", "h3", "create")], "path string, hash string, type string").write.parquet(source)
    stream = spark.readStream.schema("path string, hash string, type string").parquet(source)

    def apply(batch, number):
        changes.apply_changes(spark.read.parquet(target + "/0"), batch).write.mode("overwrite").parquet(f"{target}/{number + 1}")

    changes.upsert_stream(stream, str(tmp_path / "check"), apply).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target + "/1").collect()) == [("a", "h9"), ("c", "h3")]


def test_vectors_and_names(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, [1.0])], "id long, e array<float>")
    assert [r["id"] for r in vector_search.nearest(v, "id", "e", [1.0, 0.0], 10, 0.2).collect()] == [1, 3]
    uses = spark.createDataFrame([("f", "x")], "file_path string, name string")
    symbols = spark.createDataFrame([("f", "x", "i1", 1), ("f", "x", "i2", 2)], "file_path string, name string, id string, ordinal int")
    assert navigation.resolve_names(uses, symbols).first()["target"] == "i1" and navigation.resolve_names(uses, symbols, last=True).first()["target"] == "i2"


def test_edits_past_the_end_and_folded_imports(spark):
    assert one(spark, "a\nb", lambda c: context.replace_lines(c, 3, 4, "x")) == "a\nb"
    files = spark.createDataFrame([("p/q/a.ts", "../b"), ("p/q/a.ts", "./../r/./c"), ("p/q/a.ts", "../../../../d")], "path string, target string")
    known = spark.createDataFrame([("p/b.ts",), ("p/r/c/index.ts",)], "path string")
    assert {r["target"]: r["resolved"] for r in context.resolve_imports(files, known).collect()} == {"../b": "p/b.ts", "./../r/./c": "p/r/c/index.ts", "../../../../d": None}


def test_repeated_vectors(spark):
    stored = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], "id int, v array<double>, at int")
    new = spark.createDataFrame([(1, [5.0], 2), (1, [9.0], 1), (3, [3.0], 1), (3, [3.0], 1)], "id int, v array<double>, at int")
    assert sorted((r["id"], r["v"]) for r in vector_search.upsert(stored, new, "id", "at").collect()) == [(1, [5.0]), (2, [2.0]), (3, [3.0])]
