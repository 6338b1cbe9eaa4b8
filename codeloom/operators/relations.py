"""Relations between symbols of several files: imports, calls, instantiations, inheritance and uses of types.

Imports are resolved to files (relative paths folded, module paths, qualified names), exported names are followed over
re-exports until no new ones turn up, and names in code are looked up in the scope that this gives each file. All of
it is joins on (file, name). Uses are found where their file's text is, together with the symbol that each stands in.
``read`` does that in the pass over the text that finds the symbols, and knows by which statement a name came in, so most
names are looked up by (target, name) among the distinct ones of all files, and no file's scope has to be put together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import folded
from codeloom.operators import extract, navigation, structure
from codeloom.operators.staging import stage

# Confidence of a relation by its kind, and of a name that only the whole workspace makes unique.
CONFIDENCE = {"imports": 1.0, "extends": 0.95, "implements": 0.95, "calls": 0.9, "instantiates": 0.9, "uses": 0.8}
BY_NAME_ONLY = 0.6
ECMA = ("javascript", "typescript", "vue", "qmljs")
QUALIFIED = ("java", "kotlin", "c_sharp", "php")
#: Files that a path without its ending may mean, in order of preference.
ENDINGS = {
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs", "/index.js", "/index.ts"),
    "typescript": (".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"),
    "vue": (".vue", ".ts", ".js", "/index.ts", "/index.js"),
    "qmljs": (".js", ".qml"),
    "python": (".py", "/__init__.py", ".pyi"),
    "ruby": (".rb",),
    "lua": (".lua", "/init.lua"),
    "css": (".css", ".scss"),
}
_KEYWORDS = (
    "if", "for", "while", "switch", "return", "catch", "function", "def", "fn", "func", "sizeof", "elif", "and", "or", "not", "in", "await", "new", "super", "class", "typeof",
    "import", "export", "constructor", "this", "self", "do", "else", "match", "with", "lambda", "yield", "throw", "raise", "assert", "using", "lock", "foreach", "when", "unless", "until",
)
_DECLARED = ("function", "method", "class", "interface", "struct", "trait", "enum", "variable", "constant", "type", "module", "union")


def _items(text: Column) -> Column:
    """``a, b as c`` -> array of (name, local)."""
    one = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(F.regexp_replace(x, r"\btype ", ""))), lambda x: x.rlike(r"^[\w$*]"))
    local = lambda x: F.when(x.rlike(r" as "), F.regexp_extract(x, r" as +([\w$]+)", 1)).otherwise(F.regexp_extract(x, r"^([\w$*]+)", 1))
    return F.transform(one, lambda x: F.struct(F.regexp_extract(x, r"^([\w$*]+)", 1).alias("name"), local(x).alias("local")))


_NONE = "cast(array() as array<struct<name:string,local:string>>)"


def _target(name: Column) -> Column:
    """What an import or export statement of this name takes from; null for the export of own names."""
    package = F.regexp_replace(name, r"[.\\][\w*]+$", "")
    target = F.when(F.col("language").isin(*QUALIFIED) & (F.col("language") != "c_sharp"), package).otherwise(name)
    return F.when((F.col("kind") == "export") & ~F.col("signature").rlike(r"\bfrom\b"), F.lit(None).cast("string")).otherwise(target)


def imported_names(symbols: DataFrame, *keep: str) -> DataFrame:
    """Import and export statements -> (file_path, language, line, target, name, local, export).

    One row for each name; name is ``*`` for a whole module (local: what it is called, null for all of its names), and
    ``default`` for a default import. target is null for the export of own names. Columns of ``keep`` stay beside them.
    """
    rows = symbols.where("kind in ('import', 'export')").select("file_path", "language", F.col("start_line").alias("line"), "kind", "signature", F.col("name").alias("target"), *keep)
    s = F.col("signature")
    braces = F.regexp_extract(s, r"\{([^}]*)\}", 1)
    whole = F.regexp_extract(s, r"\* *as +([\w$]+)", 1)
    default = F.regexp_extract(s, r"^import +(?:type +)?([\w$]+) *(?:,|from\b)", 1)
    one = lambda name, local: F.array(F.struct(name.alias("name"), local.alias("local")))
    none, star, nothing = F.expr(_NONE), F.lit("*"), F.lit(None).cast("string")
    ecma = F.concat(
        F.when(braces != "", _items(braces)).otherwise(none),
        F.when(whole != "", one(star, whole)).otherwise(none),
        F.when(default != "", one(F.lit("default"), default)).otherwise(none),
        F.when((F.col("kind") == "export") & s.rlike(r"^export *\* *from"), one(star, nothing)).otherwise(none),
    )
    names = F.regexp_extract(s, r"\bimport +\(?([^)]*)\)?$", 1)
    alias = F.regexp_extract(s, r" as +(\w+)$", 1)
    python = F.when(s.rlike("^from "), F.when(F.trim(names) == "*", one(star, nothing)).otherwise(_items(names))).otherwise(one(star, F.when(alias != "", alias).otherwise(F.col("target"))))
    last = F.regexp_extract("target", r"([\w*]+)$", 1)
    qualified = F.when((F.col("language") == "c_sharp") | (last == "*"), one(star, nothing)).otherwise(one(last, F.when(alias != "", alias).otherwise(last)))
    target = _target(F.col("target"))
    found = F.when(F.col("language").isin(*ECMA), ecma).when(F.col("language") == "python", python).when(F.col("language").isin(*QUALIFIED), qualified).otherwise(one(star, nothing))
    out = rows.select("file_path", "language", "line", target.alias("target"), (F.col("kind") == "export").alias("export"), *keep, F.explode_outer(found).alias("n"))
    return out.select("file_path", "language", "line", "target", "n.name", "n.local", "export", *keep)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1)


def resolve_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (file_path, language, target) with to_path, the first file that exists of those the target may mean; null if none does.

    Relative targets start at the file's folder, others at the workspace's top and then at the file's folder. Python's
    dots lead upwards, one for the file's own folder. A target names a file with or without its ending, or a folder's index.
    """
    # what a target means depends on its file's folder alone, so it is asked once for all files of a folder
    placed = imports.withColumn("_here", _folder(F.col("file_path")))
    return placed.join(_best(placed, files), ["_here", "language", "target"], "left").drop("_here")


def _best(placed: DataFrame, files: DataFrame) -> DataFrame:
    """Each (_here, language, target) once, with the to_path that ``resolve_targets`` gives it, if there is one."""
    here = F.col("_here")
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    module = F.translate(F.regexp_replace("target", r"^\.+", ""), ".", "/")
    up = F.concat(here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), module)
    python = F.when(dots > 0, F.array(up)).otherwise(F.array(module, F.concat(here, module)))
    lua = F.translate("target", ".", "/")
    relative = F.col("target").rlike(r"^\.\.?/")
    plain = F.when(relative | F.col("language").isin("c", "cpp", "css", "dart", "ruby"), F.array(F.concat(here, "target"), F.col("target"))).otherwise(F.array(F.col("target")))
    bases = F.when(F.col("language") == "python", python).when(F.col("language") == "lua", F.array(lua, F.concat(here, lua))).otherwise(plain)
    endings = F.create_map(*[x for n, e in ENDINGS.items() for x in (F.lit(n), F.array(*map(F.lit, ("", *e))))])
    endings = F.coalesce(F.element_at(endings, F.col("language")), F.array(F.lit("")))
    options = F.flatten(F.transform(bases, lambda b: F.transform(endings, lambda e: F.concat(folded(b), e))))
    asked = placed.where("target is not null").select("_here", "language", "target").distinct()
    rows = asked.select("_here", "language", "target", F.posexplode(options).alias("_i", "_c"))
    known = files.select(F.col("path").alias("_c")).distinct()
    return rows.join(known, "_c").groupBy("_here", "language", "target").agg(F.min_by("_c", "_i").alias("to_path"))


def resolved_imports(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``imported_names`` of all symbols with their to_path. Files of a folder often have statements in common: each is read once for a folder."""
    said = symbols.where("kind in ('import', 'export')").select("file_path", F.col("start_line").alias("line"), F.struct(_folder(F.col("file_path")).alias("folder"), "language", "kind", "name", "signature").alias("said"))
    asked = said.select("said").distinct().select("said", "said.*").withColumnRenamed("folder", "file_path").withColumn("start_line", F.lit(0))
    read = resolve_targets(imported_names(asked, "said"), files).drop("file_path", "line").withColumnRenamed("said", "_said")
    return said.join(read, F.col("said").eqNullSafe(F.col("_said"))).select("file_path", "language", "line", "target", "name", "local", "export", "to_path")


def _first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first symbol (id, kind, symbol: its own name) of each key by ``order``, then by id."""
    found = rows.groupBy(*keys).agg(F.min_by(F.struct("id", "kind", "symbol"), F.struct(*order, "id")).alias("_s"))
    return found.select(*keys, "_s.id", "_s.kind", "_s.symbol")


def exported_names(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name, id, kind, symbol): what each module gives to others, followed over re-exports; symbol is its own name.

    A module is a file, or a package of the languages with qualified names. ECMAScript files export what says so;
    files of other languages all that stands at their top; Python files also what they import. New names are joined to
    the re-exports of their module until there are none, so circles end. Of several symbols under one name the first counts.
    """
    symbols = symbols.withColumn("symbol", F.col("name"))
    top = symbols.where(F.col("parent_id").isNull() & F.col("kind").isin(*_DECLARED))
    ecma = F.col("language").isin(*ECMA)
    lists = imports.where("export and target is null").select("file_path", F.col("name").alias("_own"), F.col("local").alias("_out"))
    said = top.where(~ecma | F.col("signature").rlike(r"^export\b"))
    own = said.select(F.col("file_path").alias("module"), "name", "id", "kind", "symbol", "start_line")
    own = own.unionByName(said.where(ecma & F.col("signature").rlike(r"^export +default\b")).select(F.col("file_path").alias("module"), F.lit("default").alias("name"), "id", "kind", "symbol", "start_line"))
    own = own.unionByName(top.join(lists, (top["file_path"] == lists["file_path"]) & (top["name"] == lists["_own"])).select(top["file_path"].alias("module"), F.col("_out").alias("name"), "id", "kind", "symbol", "start_line"))
    packages = symbols.where((F.col("kind") == "namespace") & F.col("language").isin(*QUALIFIED)).groupBy("file_path").agg(F.min_by("name", "start_line").alias("module"))
    inside = symbols.where(F.col("kind").isin(*_DECLARED) & F.col("language").isin(*QUALIFIED)).join(symbols.where("kind = 'namespace'").select(F.col("id").alias("parent_id"), F.lit(True).alias("_n")), "parent_id", "left")
    inside = inside.where(F.col("parent_id").isNull() | F.col("_n")).join(packages, "file_path")
    own = own.unionByName(inside.select("module", "name", "id", "kind", "symbol", "start_line"))
    known = stage(_first(own, ["module", "name"], "start_line"))
    again = imports.where("to_path is not null and (export or language = 'python') and not (name = '*' and local is not null)")
    named = stage(again.where("name <> '*'").select(F.col("file_path").alias("module"), F.col("local").alias("_as"), F.col("to_path").alias("_from"), F.col("name").alias("_name")).distinct())
    stars = stage(again.where("name = '*'").select(F.col("file_path").alias("module"), F.col("to_path").alias("_from")).distinct())
    # only modules that export again can get new names
    had = known.join(named.select("module").unionByName(stars.select("module")).distinct(), "module", "left_semi").select("module", "name")
    fresh = known
    while True:
        give = fresh.select(F.col("module").alias("_from"), F.col("name").alias("_name"), "id", "kind", "symbol")
        new = named.join(give, ["_from", "_name"]).select("module", F.col("_as").alias("name"), "id", "kind", "symbol")
        new = new.unionByName(stars.join(give.where("_name <> 'default'"), "_from").select("module", F.col("_name").alias("name"), "id", "kind", "symbol"))
        new = _first(new, ["module", "name"]).join(had, ["module", "name"], "left_anti")
        fresh = stage(new)
        if fresh.isEmpty():
            return known
        known, had = known.unionByName(fresh), had.unionByName(fresh.select("module", "name"))


def scopes(symbols: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_path, name, id, kind, symbol): what each name means in a file: its own symbol of that name, or else what an import binds it to.

    Names of a module that is imported whole under a name are bound as name.member.
    """
    own = _first(symbols.withColumn("symbol", F.col("name")).where(F.col("kind").isin(*_DECLARED)), ["file_path", "name"], "start_line")
    module = F.when(F.col("language").isin(*QUALIFIED), F.col("target")).otherwise(F.col("to_path"))
    bound = imports.where("not export").withColumn("module", module).where("module is not null")
    single = bound.where("name <> '*'").join(exports, ["module", "name"]).select("file_path", F.col("local").alias("name"), "id", "kind", "symbol")
    whole = bound.where("name = '*'").select("file_path", "module", F.col("local")).distinct().join(exports, "module")
    whole = whole.select("file_path", F.concat(F.coalesce(F.concat("local", F.lit(".")), F.lit("")), "name").alias("name"), "id", "kind", "symbol")
    package = symbols.where((F.col("kind") == "namespace") & F.col("language").isin(*QUALIFIED)).select("file_path", F.col("name").alias("module")).distinct().join(exports, "module").select("file_path", "name", "id", "kind", "symbol")
    rank = lambda df, n: df.withColumn("_r", F.lit(n))
    every = rank(own, 0).unionByName(rank(single, 1)).unionByName(rank(package, 2)).unionByName(rank(whole, 3))
    return _first(every, ["file_path", "name"], "_r")


_NAME = r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?"
_FORMS = [
    ("instantiates", "new ", re.compile(rf"(?<![\w$.])new +({_NAME})", re.ASCII)),
    ("calls", "(", re.compile(rf"(?<![\w$.])(?<!new )(?<!new  )({_NAME}) *\(", re.ASCII)),
    ("uses", ":", re.compile(rf"(?<=[\w)\]?])\?? *: *({_NAME})(?![\w$]* *\()", re.ASCII)),
]  # with what stands in all matches; none goes over a line's end
#: Statements, heads and lines of code that are remembered with the names in them, in each task, and how long a line may be for it.
KNOWN, LONGEST = 50_000, 400


def _uses_of(line: str) -> list[tuple[int, str, str]]:
    """(column, name, form) of what is used in a line of code."""
    found = set()
    for form, sign, pattern in _FORMS:
        for m in pattern.finditer(line) if sign in line else ():
            if (name := m.group(1)) not in _KEYWORDS:
                found.add((line.find(name), name, form))
    return sorted(found)


def _uses_in(code: str, known: dict[str, list[tuple[int, str, str]]]) -> list[tuple[int, int, str, str]]:
    """(line, column, name, form) of what is used in the code of one file, in the order of the places; each once. Lines are often alike."""
    out = []
    for number, line in enumerate(code.split("\n"), 1):
        if (found := known.get(line)) is None:
            found = _uses_of(line)
            if len(line) <= LONGEST:
                if len(known) >= KNOWN:
                    known.clear()
                known[line] = found
        for at, name, form in found:
            out.append((number, at, name, form))
    return out


def uses(files: DataFrame) -> DataFrame:
    """(file_path, language, line, col, name, form): names in code that are called, instantiated or used as a type.

    A name that stands several times in a line counts once in each form, at the column (from 0) of the first.
    """
    columns = {"file_path": pa.string(), "language": pa.string(), "line": pa.int32(), "col": pa.int32(), "name": pa.string(), "form": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, str, str]]] = {}
        for b in batches:
            rows = [(path, language, *u) for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for u in _uses_in(structure.code_of(language, text or ""), known)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))

    return structure.batched(files, run, "file_path string, language string, line int, col int, name string, form string").distinct()


def _holders(spans: list[tuple], places: list[tuple[int, int]]) -> list[str | None]:
    """For each place (line, col), in order, the id of the least span (line, col, end line, end col, near, size, id) that holds it."""
    spans.sort(key=lambda x: x[:2])
    heap: list[tuple] = []
    out, k = [], 0
    for line, col in places:
        while k < len(spans) and spans[k][:2] <= (line, col):
            a, c, b, d, near, size, ident = spans[k]
            heappush(heap, (near, size is not None, size or 0, ident, b, d))
            k += 1
        while heap and heap[0][4:] < (line, col):
            heappop(heap)
        out.append(heap[0][3] if heap else None)
    return out


def placed_uses(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, line, name, form, from_id): ``uses`` with the nearest function or type around each, or null.

    A file's text meets the spans of its symbols, and both are gone through in order of their places where the text is,
    so uses aren't shuffled to find out where they stand. Nearest is as in ``navigation.containing``.
    """
    near, size, first, last = navigation.nearness()
    held = symbols.where(F.col("kind").isin("function", "method", "constructor", "class", "interface", "struct", "enum", "trait") & (F.col("end_line") >= F.col("start_line")) & F.col("id").isNotNull())
    span = F.struct(F.col("start_line").alias("a"), first.alias("c"), F.col("end_line").alias("b"), last.alias("d"), near.alias("near"), size.alias("size"), "id")
    # text is much larger than what it is shuffled as, so partitions aren't put together
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = held.select(F.col("file_path").alias("path"), span.alias("s")).repartition(parts, "path").groupBy("path").agg(F.collect_list("s").alias("spans"))
    rows = files.select("path", "language", "content").repartition(parts, "path").join(spans, "path", "left")
    columns = {"file_path": pa.string(), "line": pa.int32(), "name": pa.string(), "form": pa.string(), "from_id": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, str, str]]] = {}
        for b in batches:
            out: list[tuple] = []
            around = b.column("spans")
            starts, valid = around.offsets.to_pylist(), around.is_valid().to_pylist()
            flat = list(zip(*(c.to_pylist() for c in around.values.flatten()), strict=True))
            for i, (path, language, text) in enumerate(zip(*(b.column(n).to_pylist() for n in ("path", "language", "content")), strict=True)):
                found = _uses_in(structure.code_of(language, text or ""), known)
                held = [x for x in flat[starts[i] : starts[i + 1]] if x[0] < x[2] or x[1] <= x[3]] if valid[i] else []
                out += [(path, line, name, form, ident) for (line, _, name, form), ident in zip(found, _holders(held, [u[:2] for u in found]), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), columns.values(), strict=True)], list(columns))

    return structure.batched(rows, run, "file_path string, line int, name string, form string, from_id string", "spans")


_TYPES = ("class", "interface", "struct", "enum", "trait", "union")
_HOLDERS = ("function", "method", "constructor", "class", "interface", "struct", "enum", "trait")
_ITEM, _AS, _TYPE = re.compile(r"[A-Za-z0-9_$*]+"), re.compile(r" as +([A-Za-z0-9_$]+)"), re.compile(r"\btype ")
_BRACES = re.compile(r"\{([^}]*)\}")
_DEFAULT = re.compile(r"^import +(?:type +)?([A-Za-z0-9_$]+) *(?:,|from\b)")
_FROM = re.compile(r"\bimport +\(?([^)]*)\)?$")
_LAST, _ALIAS = re.compile(r"([A-Za-z0-9_*]+)$"), re.compile(r" as +([A-Za-z0-9_]+)$")


def _single_names(language: str, target: str, signature: str) -> list[tuple[str, str, str]]:
    """(target, name, local) of the single names that an import statement brings in: ``imported_names`` without ``*`` where the text is."""

    def items(text: str) -> list[tuple[str, str]]:
        out = []
        for x in text.split(","):
            x = _TYPE.sub("", x).strip(" ")
            if m := _ITEM.match(x):
                if " as " in x:
                    out.append((m.group(), n.group(1) if (n := _AS.search(x)) else ""))
                else:
                    out.append((m.group(), m.group()))
        return out

    found: list[tuple[str, str]] = []
    if language in ECMA:
        if (m := _BRACES.search(signature)) and m.group(1):
            found = items(m.group(1))
        if m := _DEFAULT.match(signature):
            found.append(("default", m.group(1)))
    elif language == "python":
        if signature.startswith("from "):
            text = m.group(1) if (m := _FROM.search(signature)) else ""
            found = items(text) if text.strip(" ") != "*" else []
    elif language in QUALIFIED and language != "c_sharp":
        last = m.group(1) if (m := _LAST.search(target)) else ""
        target = re.sub(r"[.\\][A-Za-z0-9_*]+$", "", target)
        if last != "*":
            found = [(last, m.group(1) if (m := _ALIAS.search(signature)) else last)]
    return [(target, name, local) for name, local in found if name != "*"]


_AFTER = {"python": re.compile(r"\(([^)]*)\)"), "ruby": re.compile(r"< *([A-Za-z0-9_:]+)")}
_AFTER |= dict.fromkeys(("c_sharp", "cpp", "kotlin", "swift"), re.compile(r"(?<!:):(?!:) *([^{]*)$"))
_EXTENDS = re.compile(r"\b(?:extends|implements|with) +([^{]*)$")
_BRACKETS = re.compile(r"<[^<>]*>|\([^()]*\)")
_WORDS = re.compile(r"\b(?:public|private|protected|virtual|extends|implements|with|where)\b")
_BASE = re.compile(r"[A-Za-z_][A-Za-z0-9_.:]*\Z")


def _base_names(language: str, signature: str) -> list[str]:
    """``bases`` where the text is."""
    m = _AFTER.get(language, _EXTENDS).search(signature)
    names = [x.strip(" ") for x in _WORDS.sub(",", _BRACKETS.sub(" ", m.group(1) if m else "")).split(",")]
    return list(dict.fromkeys(x for x in names if _BASE.match(x)))


_READ = structure._SYMBOLS + ", form string, from_id string, own_id string, own_kind string, target string, imported string"
#: What ``read`` gives of a file itself, of a name that is used, of a base in a type's head.
FILE, BASE = "file", "extends"


def _used(path: str, language: str, code: str, rows: list[tuple], said_by: dict, lines: dict) -> Iterator[tuple]:
    """(name, line, form, from_id, from_name, own_id, own_kind, target, imported) of the uses and bases in a file with these symbols.

    own is the file's first symbol of the name; names that mean what they stand in go. If there is none, target and
    imported are what the only import that brings the name in says; null, if there are several.
    """

    def ident(name: str, line: int, column: int) -> str:
        return hashlib.md5(":".join([*([] if path is None else [path]), name, str(line - 1), str(column)]).encode()).hexdigest()

    own: dict[str, tuple] = {}
    brought: dict[str, set] = {}
    spans, names, heads = [], {}, []
    for kind, name, a, c, b, d, _, _, head, _, _, parent, around, *_ in rows:
        if kind == "import" or kind in _TYPES:
            key = kind == "import", language, name, head
            if (said := said_by.get(key)) is None:
                if len(said_by) >= KNOWN:
                    said_by.clear()
                signature = structure.SIGN.sub("", head).strip(" ")
                said = said_by[key] = _single_names(language, name, signature) if kind == "import" else _base_names(language, signature)
            if kind == "import":
                for target, imported, local in said:
                    brought.setdefault(local, set()).add((target, imported))
                continue
        kind = structure.kind_within(language, kind, name, around, parent)
        if kind in _DECLARED or kind in _HOLDERS:
            i = ident(name, a, c)
            if kind in _DECLARED and (name not in own or (a, i) < own[name][:2]):
                own[name] = a, i, kind
            if kind in _TYPES:
                names[i] = name
                heads += [(a, n, BASE, i) for n in said]
            if kind in _HOLDERS and (a < b or a == b and c <= d):
                names[i] = name
                spans.append((a, c, b, d, navigation.NEARNESS.get(kind, 5), (b - a) * 1000 + d - c, i))
    found = _uses_in(code, lines)
    held = [(line, name, form, i) for (line, _, name, form), i in zip(found, _holders(spans, [u[:2] for u in found]), strict=True)]
    for line, name, form, i in held + heads:
        if mine := own.get(name):
            if mine[1] != i:
                yield name, line, form, i, names.get(i), mine[1], mine[2], None, None
        else:
            one = brought.get(name, ())
            yield name, line, form, i, names.get(i), None, None, *(next(iter(one)) if len(one) == 1 else (None, None))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files (path, language, content) -> (paths, symbols, names): what ``relations`` needs of them, found in one pass over the text and staged.

    symbols are those of ``structure.symbols`` without doc_comment, visibility and bytes, nor ids of statements. names (file_path, language, line,
    name, form, from_id, from_name, own_id, own_kind, target, imported) are ``placed_uses`` and ``bases``, with what
    ``_used`` knows of them. paths has a row for each file.
    """
    declarations = extract.DECLARATIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, batch, known = structure.heads_of(declarations), structure.batcher(_READ), {}
        lines: dict[str, list[tuple[int, str, str]]] = {}
        columns = [(n, pa.string() if t == "string" else pa.int32()) for n, t in (c.split() for c in _READ.split(", "))]
        given = ("path", "language", "name", "start_line", "form", "from_id", "parent_name", "own_id", "own_kind", "target", "imported")

        def uses(rows: list[tuple]) -> pa.RecordBatch:
            values = dict(zip(given, zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(values[n], t) if n in values else pa.nulls(len(rows), t) for n, t in columns], [n for n, _ in columns])

        for b in batches:
            symbols: list[tuple] = []
            used: list[tuple] = []
            for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                lexed = structure._read(language, text, heads.get(language))
                rows = list(structure._nested(structure._rows(language, text, heads[language], lexed, False))) if language in heads else []
                symbols += [(path, language, *r, *[None] * 6) for r in rows]
                used.append((path, language, None, None, FILE, *[None] * 6))
                used += [(path, language, *u) for u in _used(path, language, structure.with_lines(lexed[0], text), rows, known, lines)]
                if len(symbols) > 10_000:
                    yield batch(symbols)
                    symbols = []
                if len(used) > 10_000:
                    yield uses(used)
                    used = []
            if symbols:
                yield batch(symbols)
            if used:
                yield uses(used)

    rows = structure.described(structure.batched(files, run, _READ), "form", "from_id", "own_id", "own_kind", "target", "imported")
    symbol = F.col("form").isNull()
    rows = rows.withColumn("id", F.when(symbol & ~F.col("kind").isin("import", "export"), F.col("id"))).withColumn("parent_id", F.when(symbol, F.col("parent_id")))
    rows = stage(rows.withColumnRenamed("parent_name", "from_name").drop("start_byte", "end_byte", "doc_comment", "visibility", "depth"))
    names = rows.where(~symbol & (F.col("form") != FILE))
    return (
        rows.where(F.col("form") == FILE).select(F.col("file_path").alias("path")),
        rows.where(symbol).drop("form", "from_id", "from_name", "own_id", "own_kind", "target", "imported"),
        names.select("file_path", "language", F.col("start_line").alias("line"), "name", "form", "from_id", "from_name", "own_id", "own_kind", "target", "imported"),
    )


def relations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files (path, language, content) and their ``structure.symbols`` -> (from_id, to_id, kind, file_path, line, confidence).

    Kinds are imports (between files, ids are ``file:`` and the path), extends, implements, calls, instantiates and
    uses. from_id is the nearest function or type around the use, or the file. A name that neither the file nor its
    imports know is taken from anywhere in the workspace if just one symbol has it, with less confidence; calls of members
    of unknown objects and names that stay unknown give none. A relation that repeats on a line counts once.
    """
    imports = stage(resolved_imports(symbols, files))
    heads = symbols.where(F.col("kind").isin(*_TYPES)).select("id", "file_path", F.col("start_line").alias("line"), bases(F.col("language"), F.col("signature")).alias("names"))
    heads = heads.select(F.col("id").alias("from_id"), "file_path", "line", F.explode("names").alias("name"), F.lit(BASE).alias("form"))
    asked = placed_uses(files, symbols).select("from_id", "file_path", "line", "name", "form").unionByName(heads).withColumn("from_name", F.lit(None).cast("string"))
    exports = exported_names(symbols, imports)
    named = _edges(_looked_up(asked, symbols, imports, exports))
    return named.select("from_id", "to_id", "kind", "file_path", "line", "confidence").distinct().unionByName(_between(imports))


def named_relations(files: DataFrame) -> DataFrame:
    """``relations`` of files by ``read``, with from_name and to_name, the names of the symbols or the paths of files.

    Names of a file's own are known from its text. Those that one statement alone can have brought in are looked up by what
    it says, each once for all files of a folder. Only for the others the scopes of their files are put together.
    """
    paths, symbols, names = read(files)
    said = symbols.where("kind in ('import', 'export')")
    placed = said.select("file_path", "language", F.col("start_line").alias("line"), _target(F.col("name")).alias("target"), _folder(F.col("file_path")).alias("_here"))
    best = stage(_best(placed, paths))
    names = names.withColumn("_here", _folder(F.col("file_path")))
    keys = ["imported", "target", "language", "_here"]
    again = stage(resolved_imports(said.where("kind = 'export' or language = 'python'"), paths))
    exports = exported_names(symbols, again)
    module = F.when(F.col("language").isin(*QUALIFIED), F.col("target")).otherwise(F.col("to_path"))
    asked = names.where("target is not null").select(*keys).distinct().join(best, keys[1:], "left").withColumn("module", module)
    known = exports.select("module", F.col("name").alias("imported"), "id", F.col("kind").alias("to_kind"), "symbol")
    known = stage(asked.join(known, ["module", "imported"]).select(*keys, "id", "to_kind", "symbol"))
    columns = ["from_id", "from_name", "file_path", "line", "name", "form"]
    own = names.where("own_id is not null").select(*columns, F.col("own_id").alias("id"), F.col("own_kind").alias("kind"), F.col("name").alias("symbol"))
    other = names.where("own_id is null")
    sure = own.unionByName(other.join(known, keys).select(*columns, "id", F.col("to_kind").alias("kind"), "symbol")).withColumn("_sure", F.lit(True))
    rest = stage(other.join(known, keys, "left_anti").select(*columns))
    if not rest.isEmpty():
        those = stage(rest.select("file_path").distinct())
        imports = stage(resolved_imports(said.join(those, "file_path", "left_semi"), paths))
        sure = sure.unionByName(_looked_up(rest, symbols, imports, exports, those))
    edges = _edges(sure).withColumn("from_name", F.coalesce("from_name", "file_path")).select("from_id", "to_id", "kind", "file_path", "line", "confidence", "from_name", F.col("symbol").alias("to_name"))
    between = _between(placed.join(best, ["_here", "language", "target"]))
    return edges.distinct().unionByName(between.withColumn("from_name", F.col("file_path")).withColumn("to_name", F.substring("to_id", len("file:") + 1, 1 << 30)))


def _between(imports: DataFrame) -> DataFrame:
    """Relations between files, by statements with a to_path."""
    return imports.where("to_path is not null").select(
        F.concat(F.lit("file:"), "file_path").alias("from_id"), F.concat(F.lit("file:"), "to_path").alias("to_id"), F.lit("imports").alias("kind"), "file_path", "line", F.lit(CONFIDENCE["imports"]).alias("confidence")
    ).distinct()


def _looked_up(asked: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame, those: DataFrame | None = None) -> DataFrame:
    """Names ``asked`` for with the symbol (id, kind, symbol) that each means in its file, or else anywhere; those that stay unknown go.

    ``those`` are the files that ask, if they aren't all.
    """
    scope = scopes(symbols, imports, exports) if those is None else scopes(symbols, imports, exports).join(those, "file_path", "left_semi")
    named = stage(asked.join(scope, ["file_path", "name"], "left"))
    # only what its file doesn't know is looked for everywhere
    unique = symbols.where(F.col("kind").isin(*_DECLARED)).groupBy("name").agg(F.min("id").alias("id"), F.min("kind").alias("kind"), F.count("*").alias("n")).where("n = 1").drop("n")
    anywhere = named.where("id is null").drop("id", "kind", "symbol").join(unique, "name").withColumn("symbol", F.col("name")).withColumn("_sure", F.lit(False))
    return named.where("id is not null").withColumn("_sure", F.lit(True)).unionByName(anywhere)


def _edges(named: DataFrame) -> DataFrame:
    """Names with what they mean -> relations by their forms, those that fit."""
    named = named.withColumn("from_id", F.coalesce("from_id", F.concat(F.lit("file:"), "file_path")))
    named = named.withColumnsRenamed({"id": "to_id", "kind": "to_kind"}).where("to_id <> from_id")
    form = F.col("form")
    typed = F.col("to_kind").isin("class", "struct")
    kind = F.when((form == BASE) & F.col("to_kind").isin("interface", "trait"), "implements").when((form == "calls") & typed, "instantiates").otherwise(form)
    fits = (form != "calls") | F.col("to_kind").isin("function", "method", "class", "struct", "variable", "constant")
    sure = F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), kind)
    confidence = F.when(F.col("_sure"), sure).otherwise(F.least(sure, F.lit(BY_NAME_ONLY)))
    return named.where(fits).select("from_id", "to_id", kind.alias("kind"), "file_path", "line", confidence.alias("confidence"), "from_name", "symbol")


def bases(language: Column, signature: Column) -> Column:
    """The names of the types that a type's head says it extends or implements."""
    after = F.when(language.isin("python"), F.regexp_extract(signature, r"\(([^)]*)\)", 1))
    after = after.when(language == "ruby", F.regexp_extract(signature, r"< *([\w:]+)", 1))
    after = after.when(language.isin("c_sharp", "cpp", "kotlin", "swift"), F.regexp_extract(signature, r"(?<!:):(?!:) *([^{]*)$", 1))
    after = after.otherwise(F.regexp_extract(signature, r"\b(?:extends|implements|with) +([^{]*)$", 1))
    plain = F.regexp_replace(F.regexp_replace(after, r"<[^<>]*>|\([^()]*\)", " "), r"\b(?:public|private|protected|virtual|extends|implements|with|where)\b", ",")
    return F.array_distinct(F.filter(F.transform(F.split(plain, ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Za-z_][\w.:]*$")))
