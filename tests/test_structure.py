"""Units, symbols, positions, containment and relations of source files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import navigation, relations, structure
from codeloom.operators.lexing import LEXICONS, blank, units

FILES = "path string, language string, content string"
SOURCES = {
    "typescript": "import { x } from './y';\n// class InComment {\nconst t = `class InString { ${f({ a: `n ${1}` })} }\nclass Deeper {`;\nexport class A<T>\n  extends B implements C {\n  private n: number = 5\n  /* doc */\n  method(a: string,\n         b = \"}\"): void {\n    if (/[{\"]/.test(a)) { helper(b) }\n    items.map((x) => { return g(x); });\n  }\n}\n",
    "python": 'class A(B):\n    """doc: class X:"""\n    def f(self,\n          a):\n        s = """\nclass Hidden:\n"""\n        if a:\n            return "def g():"\n    async def g(self): pass\ndef _top():\n    return {\n      "a": 1}\n',
    "ruby": "module M\n  class A < B\n    # doc\n    def go(x)\n      return 1 if x\n      list.each do |i|\n        puts <<~T\n          class Hidden\n        T\n      end\n    end\n    private\n    def inner; 1; end\n  end\nend\n",
    "cpp": "template <typename T>\nclass A : public B {\npublic:\n  A(int x) {}\nprivate:\n  virtual int f(int a) const { return R\"x(class Q { )\" )x\"; }\n};\n",
    "c": "#define N 5\ntypedef struct { int a; } T;\nstatic int f(int a,\n   char *b)\n{\n  char c = '{'; return a;\n}\n",
    "rust": "impl<'a> T for A<'a> {\n    fn f(&self) -> char { '{' } /* a /* fn b() { */ c */\n}\nfn raw() -> &str { r#\"fn q() { \"}\"# }\n",
    "go": "package main\nimport (\n\t\"fmt\"\n\tm \"a/b\"\n)\nconst (\n\tA = 1\n\tB = 2\n)\ntype S struct {\n\tA int\n}\nfunc (s *S) Do(a int) (int, error) {\n\treturn `{`, nil\n}\n",
    "bash": "go() {\n  x=${y:-\"}\"}\n  cat <<EOF\nfunction hidden() {\nEOF\n}\n",
    "sql": "CREATE TABLE users (\n  id INT PRIMARY KEY,\n  name VARCHAR(20), -- x;\n  FOREIGN KEY (id) REFERENCES o(id)\n);\nCREATE FUNCTION f() RETURNS int AS $$ BEGIN; END; $$;\n",
    "vue": "<template>\n<p>it's</p>\n</template>\n<script>\nexport default {\n  go(a) { return 1 }\n}\n</script>\n<style>\n.a { }\n</style>\n",
    "lua": "function m.go(a)\n  if a then return function() return 1 end end\n  --[[ function no() ]]\n  local s = [[ function z() ]]\nend\n",
    "c_sharp": "namespace N {\n  /// <summary>x</summary>\n  [Attr]\n  public class A : B\n  {\n    public int P { get; set; }\n    public A(int x) { }\n    string s = @\"class \"\"Z\"\" {\";\n  }\n}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(f"f.{n}", n, t) for n, t in SOURCES.items()] + [("none", "python", None), ("other", "unknown", "class X {")], FILES)
    rows = structure.symbols(files).collect()
    names = {r["id"]: r["name"] for r in rows}
    return {(r["language"], r["name"], r["kind"]): (r["start_line"], r["end_line"], names.get(r["parent_id"]), r["visibility"], r["doc_comment"]) for r in rows}


def test_symbols(found):
    expected = {
        ("typescript", "./y", "import"): (1, 1, None, "public", None),
        ("typescript", "t", "variable"): (3, 4, None, "public", "// class InComment {"),
        ("typescript", "A", "class"): (5, 14, None, "public", None),
        ("typescript", "n", "property"): (7, 7, "A", "private", None),
        ("typescript", "method", "method"): (9, 13, "A", "public", "/* doc */"),
        ("python", "A", "class"): (1, 10, None, "public", "doc: class X:"),
        ("python", "f", "method"): (3, 9, "A", "public", None),
        ("python", "g", "method"): (10, 10, "A", "public", None),
        ("python", "_top", "function"): (11, 13, None, "private", None),
        ("ruby", "M", "module"): (1, 15, None, "public", None),
        ("ruby", "A", "class"): (2, 14, "M", "public", None),
        ("ruby", "go", "method"): (4, 11, "A", "public", "# doc"),
        ("ruby", "inner", "method"): (13, 13, "A", "private", None),
        ("cpp", "A", "class"): (1, 7, None, "public", None),
        ("cpp", "A", "constructor"): (4, 4, "A", "public", None),
        ("cpp", "f", "method"): (6, 6, "A", "private", None),
        ("c", "N", "constant"): (1, 1, None, "public", None),
        ("c", "T", "type"): (2, 2, None, "public", None),
        ("c", "f", "function"): (3, 7, None, "public", None),
        ("rust", "f", "function"): (2, 2, None, "public", None),
        ("rust", "raw", "function"): (4, 4, None, "public", None),
        ("go", "fmt", "import"): (3, 3, None, "public", None),
        ("go", "a/b", "import"): (4, 4, None, "public", None),
        ("go", "A", "constant"): (7, 7, None, "public", None),
        ("go", "B", "constant"): (8, 8, None, "public", None),
        ("go", "S", "class"): (10, 12, None, "public", None),
        ("go", "Do", "method"): (13, 15, None, "public", None),
        ("bash", "go", "function"): (1, 6, None, "public", None),
        ("sql", "users", "class"): (1, 5, None, "public", None),
        ("sql", "id", "field"): (2, 2, "users", "public", None),
        ("sql", "name", "field"): (3, 3, "users", "public", None),
        ("sql", "f", "function"): (6, 6, None, "public", None),
        ("vue", "script", "class"): (4, 8, None, "public", None),
        ("vue", "go", "method"): (6, 6, "script", "public", None),
        ("lua", "m.go", "function"): (1, 5, None, "public", None),
        ("c_sharp", "A", "class"): (3, 9, "N", "public", "/// <summary>x</summary>"),
        ("c_sharp", "P", "property"): (6, 6, "A", "public", None),
        ("c_sharp", "A", "constructor"): (7, 7, "A", "public", None),
    }
    for key, value in expected.items():
        assert found.get(key) == value, key
    assert not {n for _, n, _ in found} & {"InComment", "InString", "Deeper", "Hidden", "hidden", "Q", "q", "Z", "no", "z", "X"}


@pytest.mark.parametrize("language", sorted(LEXICONS))
def test_lexing_any_text(language):
    """Whatever the text: same length, same lines, units nested and inside it."""
    rng = random.Random(language)
    pieces = ["{", "}", "(", ")", "[", "]", ";", "\n", " ", "'", '"', "`", "${", "/*", "*/", "//", "#", "--", "--[[", "]]", '"""', "\\", "class A", "def f", "end", "do", "if x", "<<EOF", "EOF", "r#", "$$", "ä", "=", ",", ":", "/"]
    for _ in range(150):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        bare, code, _ = blank(text, LEXICONS[language])
        assert len(bare) == len(code) == len(text) and code.count("\n") == text.count("\n")
        out = units(bare, code, LEXICONS[language])
        for i, u in enumerate(out):
            assert 0 <= u.start <= u.head <= u.end <= len(text) or u.tail
            assert -1 <= u.parent < i and (u.parent < 0 or out[u.parent].start <= u.start)


def test_bytes_and_registered_languages(spark):
    rows = [("a.py", "python", "x = 'ä'\ndef ü(): pass\n\ndef f():\n  return 'é'\n"), ("b.own", "own", "thing Alpha\n  thing Beta\n")]
    got = {r["name"]: r for r in structure.symbols(spark.createDataFrame(rows, FILES), {"own": [("class", r"^thing +(\w+)")]}).collect()}
    text = rows[0][2].encode()
    assert text[got["f"]["start_byte"] : got["f"]["end_byte"]].decode() == "def f():\n  return 'é'"
    assert (got["Alpha"]["start_line"], got["Beta"]["start_line"], got["Beta"]["language"]) == (1, 2, "own")


def test_code_only(spark):
    rows = [(f"f.{n}", n, t) for n, t in SOURCES.items()]
    for r in structure.code_only(spark.createDataFrame(rows, FILES)).collect():
        assert [len(x) for x in r["content"].split("\n")] == [len(x) for x in SOURCES[r["language"]].split("\n")]
        assert "Hidden" not in r["content"] and "InString" not in r["content"]


def test_span_index_is_logarithmic(spark):
    """A file of 100,000 spans, many of them around each probe: a probe meets one entry for each level."""
    n = 100_000
    spans = spark.range(n).select(F.lit("f").alias("file"), "id", (F.col("id") % 1000).alias("start_line"), (F.lit(3 * n) - F.col("id")).alias("end_line"))
    index = navigation.span_index(spans, "file").cache()
    per_level = index.groupBy("file", "level", "bin").count().agg(F.max("count")).first()[0]
    assert per_level == 1 and index.agg(F.max("level")).first()[0] <= 19
    probes = spark.createDataFrame([(1, "f", 500), (2, "f", 250_000), (3, "f", 3 * n + 5)], "probe_id int, file string, line int")
    got = {r["probe_id"]: (r["id"], r["size"]) for r in navigation.at_position(probes, spans, "file").collect()}
    brute = lambda line: min((3 * n - i - i % 1000, i) for i in range(n) if i % 1000 <= line <= 3 * n - i)
    assert got == {p: brute(line)[::-1] for p, line in ((1, 500), (2, 250_000))}


def test_containing_against_brute_force(spark):
    rng = random.Random(4)
    spans = []
    for i in range(400):
        a, b = sorted((rng.randint(1, 60), rng.randint(1, 60)))
        spans.append(("f", i, a, b, rng.randint(0, 20), rng.randint(0, 40), rng.choice(["function", "class", "variable", "other"])))
    probes = [(i, "f", rng.randint(0, 62), rng.randint(0, 45)) for i in range(300)]
    want = {}
    for p, _, line, col in probes:
        inside = [(navigation.NEARNESS.get(k, 5), (b - a) * 1000 + d - c, i) for _, i, a, b, c, d, k in spans if a <= line <= b and (line > a or col >= c) and (line < b or col <= d)]
        if inside:
            want[p] = min(inside)[2]
    symbols = spark.createDataFrame(spans, "file_path string, id int, start_line int, end_line int, start_column int, end_column int, kind string")
    got = {r["probe_id"]: r["id"] for r in navigation.containing(spark.createDataFrame(probes, "probe_id int, file_path string, line int, col int"), symbols).collect()}
    assert got == want


def test_deep_containment(spark):
    """A chain of 300 rows, a circle, a missing parent."""
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 5555), (3000, 2000), (4000, 299)]
    df = spark.createDataFrame(rows, "id int, up int")
    got = {r["id"]: r["depth"] for r in navigation.containment_tree(df, ["id"], ["up"]).collect()}
    assert got == {**{i: i for i in range(300)}, 4000: 300}


def test_relations(spark):
    files = [
        ("src/a.ts", "typescript", "import { run as go, Shape } from './lib';\nimport * as u from '../util/x';\nimport Def from './lib/deep';\nexport class Box extends Shape implements Drawable {\n  draw(): Size {\n    go(1);\n    u.help(2);\n    const s = new Def();\n    lonely();\n    unknown(go);\n  }\n}\n"),
        ("src/lib/index.ts", "typescript", "export * from './deep';\nexport { start as run } from './deep';\nexport * from '../lib';\nexport interface Drawable { }\n"),
        ("src/lib/deep.ts", "typescript", "export function start(n) { }\nexport class Shape { }\nexport default class Main { }\nfunction hidden() { }\nexport interface Size { }\n"),
        ("util/x.ts", "typescript", "export function help(n) { }\n"),
        ("other/y.ts", "typescript", "function lonely() { }\n"),
        ("p/m.py", "python", "from .q import Base as B, tool\nimport r\n\nclass K(B):\n    def f(self):\n        tool()\n        r.act()\n"),
        ("p/q.py", "python", "from r import tool\nclass Base:\n    pass\n"),
        ("r.py", "python", "def tool():\n    pass\ndef act():\n    pass\n"),
        ("j/a/A.java", "java", "package j.a;\nimport j.b.Thing;\npublic class A extends Thing {\n    public void go() {\n        Thing t = new Thing();\n    }\n}\n"),
        ("j/b/T.java", "java", "package j.b;\npublic class Thing {\n}\n"),
    ]
    df = spark.createDataFrame(files, FILES)
    symbols = structure.symbols(df).cache()
    names = {r["id"]: r["name"] for r in symbols.collect()}
    got = {(names.get(r["from_id"], r["from_id"]), names.get(r["to_id"], r["to_id"]), r["kind"], r["confidence"]) for r in relations.relations(df, symbols).collect()}
    expected = {
        ("Box", "Shape", "extends", 0.95), ("draw", "start", "calls", 0.9), ("draw", "help", "calls", 0.9), ("draw", "Main", "instantiates", 0.9), ("draw", "lonely", "calls", 0.6), ("draw", "Size", "uses", 0.6),
        ("K", "Base", "extends", 0.95), ("f", "tool", "calls", 0.9), ("f", "act", "calls", 0.9), ("A", "Thing", "extends", 0.95), ("go", "Thing", "instantiates", 0.9), ("Box", "Drawable", "implements", 0.6),
        ("file:src/a.ts", "file:src/lib/index.ts", "imports", 1.0), ("file:src/a.ts", "file:util/x.ts", "imports", 1.0), ("file:src/a.ts", "file:src/lib/deep.ts", "imports", 1.0),
        ("file:src/lib/index.ts", "file:src/lib/deep.ts", "imports", 1.0), ("file:src/lib/index.ts", "file:src/lib/index.ts", "imports", 1.0),
        ("file:p/m.py", "file:p/q.py", "imports", 1.0), ("file:p/m.py", "file:r.py", "imports", 1.0), ("file:p/q.py", "file:r.py", "imports", 1.0),
    }
    assert expected - got == set()
    assert not [g for g in got if g[1] in ("hidden", "unknown")]


def test_folded(spark):
    df = spark.createDataFrame([("a/b/../c/./d", "a/c/d"), ("../x", "x"), ("/a/../../b", "/b"), ("a//b", "a/b")], "p string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", text.folded(F.col("p")).alias("got")).collect())
