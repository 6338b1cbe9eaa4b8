"""Relations from one pass over the text: they are those of symbols and uses that are joined by file, and no scope is put together for what one statement says."""

from __future__ import annotations

import random

from codeloom.code_queries import code_relations
from codeloom.operators import lexing, relations, structure

FILES = "path string, language string, content string"
ODD = [
    ("lib/a.ts", "typescript", "export function run(n: number) { }\nexport default class Base { go() { run(1); this.go(); } }\nexport interface Shape { }\nfunction hidden() { }\n"),
    ("lib/b.ts", "typescript", "export { run as start, type Shape } from './a';\nexport * from './a';\nexport const one = (x) => x;\n"),
    ("lib/index.ts", "typescript", "export * from './b'\nexport { default as Root } from './a'\n"),
    ("app/a.ts", "typescript", "import Base, { run,\n  type Shape as S } from '../lib/a';\nimport { start } from '../lib';\nimport * as all from '../lib/b';\nclass K extends Base implements S {\n  m(s: S) { run(1); start(2); all.one(3); all.run(4); new Base(); m(5); }\n}\nrun(2); gone(1); only(3); hidden();\n"),
    ("app/twice.ts", "typescript", "import { run } from '../lib/a';\nimport { one as run } from '../lib/b';\nfunction f() { run(1) }\n"),
    ("app/own.ts", "typescript", "import { run } from '../lib/a';\nfunction run() { run(1) }\nfunction g() { run(2); run(3);\n run(4) }\nimport { nothing } from '../lib/a';\nnothing(); /* run(9) */ `${run(8)}`\n"),
    ("app/x.py", "python", "from pkg.base import (thing, other as o)\nfrom pkg.base import *\nimport pkg.base as pb\nclass A(thing, o):\n    def go(self, x: thing):\n        o(1); pb.third(); third(2)\n"),
    ("pkg/base.py", "python", "class thing: pass\nclass other: pass\ndef third(): pass\n"),
    ("j/P.java", "java", "package j.p;\npublic class P { public void use() { new Q(); } P() { } }\n"),
    ("j/Q.java", "java", "package j.p;\nimport k.R;\nimport k.*;\npublic class Q extends R { void f() { new P(); new S(); } }\n"),
    ("k/R.java", "java", "package k;\npublic class R { }\n"), ("k/S.java", "java", "package k;\nclass S { }\nenum only { A }\n"),
    ("n/none.txt", "unknown", "run(1); a: Base\n"), ("n/null.ts", "typescript", None), ("n/x.rb", "ruby", "class Z < Base\n  def m\n    run(1)\n  end\nend\n"), ("n/y.rs", None, "run(2)\n"),
    ("c/x.cs", "c_sharp", "using k;\nnamespace c { class X : R { void f(S s) { run(1); } } }\n"), ("v/x.vue", "vue", "<script>\nimport { run } from '../lib/a'\nfunction v() { run(1) }\n</script>\n"),
]


def test_one_pass_gives_the_same_relations(spark):
    files = spark.createDataFrame(ODD, FILES)
    symbols = structure.symbols(files).cache()
    want = sorted(tuple(r) for r in relations.relations(files, symbols).collect())
    got = relations.named_relations(files).collect()
    assert sorted(tuple(r)[:6] for r in got) == want and len(want) == 40
    assert {r[2] for r in want} >= {"imports", "extends", "implements", "calls", "instantiates", "uses"}
    names = {r["id"]: r["name"] for r in symbols.collect()}
    assert all((r["from_name"], r["to_name"]) == tuple(names.get(r[f"{s}_id"], r[f"{s}_id"].removeprefix("file:")) for s in ("from", "to")) for r in got)


def test_scopes_are_put_together_only_for_files_that_ask(spark, monkeypatch):
    """Of the tables' files only those of suppliers name what no statement says (a type, number): the imports of customers' files aren't joined to their uses."""
    asked, scopes = [], relations.scopes
    monkeypatch.setattr(relations, "scopes", lambda symbols, imports, exports: (asked.append(imports.select("file_path").distinct().collect()), scopes(symbols, imports, exports))[1])
    assert code_relations(spark, "/root/testdata/sf0.001").where("kind = 'calls'").count() > 0
    assert [r for rows in asked for r in rows if r["file_path"].startswith("app/")] == []


def test_text_is_written_and_read_once(spark, monkeypatch):
    """Neither text nor the uses in it are written to be joined to symbols again."""
    staged, stage = [], relations.stage
    monkeypatch.setattr(relations, "stage", lambda df: (staged.append(df), stage(df))[1])
    monkeypatch.setattr(relations, "placed_uses", None)
    relations.named_relations(spark.createDataFrame(ODD, FILES))
    assert sum("MapInArrow" in df._jdf.queryExecution().executedPlan().toString() for df in staged) == 1
    assert not any("content" in df.columns for df in staged)


def test_braces_are_passed_over_as_one_by_one(monkeypatch):
    """Brackets without others inside, lists of names and empty line ends are steps that change nothing."""
    words = ["import ", "export ", "const ", "(", ")", "{", "}", "[", "]", ";", "\n", " ", "a", ",", "=", "from 'x'", "{ a, b }", "(a, b)", "()", "import (\n", "class A ", "=>", "#define X", "'s'", ":"]
    rng = random.Random(7)
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    read = lambda: [[lexing.units(b, c, lexing.LEXICONS[n]) for b, c, _ in [lexing.blank(t, lexing.LEXICONS[n])]] for t in texts for n in ("typescript", "go", "c")]
    got = read()
    monkeypatch.setattr(lexing, "_BRACE", lexing.re.compile(r"[{}()\[\];\n]"))
    monkeypatch.setattr(lexing, "_INSIDE", lexing.re.compile(r"(?!)"))
    assert got == read()
