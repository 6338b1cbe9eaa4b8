"""Relations read each statement once for a folder, and find what uses stand in without shuffling them."""

from __future__ import annotations

from codeloom.operators import relations, structure

FILES = "path string, language string, content string"


def test_statements_are_read_once_for_a_folder(spark, monkeypatch):
    """Twenty files of each of two folders import by the same statement: it is read twice, and means another file in each folder."""
    head = "import { run } from './lib';\n"
    rows = [(f"{d}/f{i}.ts", "typescript", head + f"export function g{i}() {{\n  run(1); run(2);\n}}\nrun(3);\n") for d in "ab" for i in range(20)]
    rows += [(f"{d}/lib.ts", "typescript", "export function run(n) { }\n") for d in "ab"]
    files = spark.createDataFrame(rows, FILES)
    symbols = structure.symbols(files).cache()
    asked, read = [], relations.imported_names
    monkeypatch.setattr(relations, "imported_names", lambda s, *keep: (asked.append(s.count()), read(s, *keep))[1])
    names = {r["id"]: (r["file_path"], r["name"]) for r in symbols.collect()}
    got = sorted((names.get(r["from_id"], r["from_id"]), names.get(r["to_id"], r["to_id"]), r["kind"], r["line"]) for r in relations.relations(files, symbols).where("kind = 'calls'").collect() if r["from_id"] in names)
    assert got == sorted((((f"{d}/f{i}.ts", f"g{i}"), (f"{d}/lib.ts", "run"), "calls", 3)) for d in "ab" for i in range(20))
    assert asked == [2]


def test_uses_meet_their_symbols_where_the_text_is(spark):
    """Text and spans are shuffled once, uses aren't; the nearest kind holds a use, as by navigation.containing, and a file without symbols its own."""
    text = "function f() {\n  class K {\n    m() { a(1); }\n  }\n  b(2); `${c(3)}`; // d(4)\n}\ne(5);\nlet s = 'x(6)';\n"
    files = spark.createDataFrame([("a.ts", "typescript", text), ("b.ts", "typescript", "g(1);\n"), ("c.ts", "typescript", None)], FILES)
    symbols = structure.symbols(files).cache()
    names = {r["id"]: r["name"] for r in symbols.collect()}
    df = relations.placed_uses(files, symbols)
    assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    got = {(r["file_path"], r["name"]): names.get(r["from_id"]) for r in df.collect() if r["form"] == "calls"}
    assert got == {("a.ts", "f"): "f", ("a.ts", "m"): "m", ("a.ts", "a"): "m", ("a.ts", "b"): "f", ("a.ts", "c"): "f", ("a.ts", "e"): None, ("b.ts", "g"): None}
