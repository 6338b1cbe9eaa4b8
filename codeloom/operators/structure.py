"""Symbols of source files with their spans, nesting, visibility and documentation.

Files are read in Arrow batches by a lexer with a stack of scopes (``lexing``), which gives nested units of code:
statements and blocks with their heads, wherever lines break, and without what stands in strings and comments. Heads
are tried against the declarations of their language there and then, and a symbol's parent is the nearest unit around
it that declares something (conditions, loops and callbacks between them are passed over); access labels hold for the
units that follow them in the same one. As a file is a row, only what declares something leaves the batch, and nothing
of it is shuffled or joined.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators import extract
from codeloom.operators.lexing import LEXICONS, Lexicon, Lines, Unit, blank, units, with_lines

#: Kinds of symbols that have members.
TYPES = ("class", "interface", "struct", "trait", "enum", "namespace", "module", "union")
#: Rows of files in an Arrow batch of the lexer.
BATCH_FILES = 256
#: Heads that are remembered with what they declare, for each language.
KNOWN_HEADS = 50_000
_SYMBOLS = "path string, language string, kind string, name string, start_line int, start_column int, end_line int, end_column int, start_byte int, end_byte int, head string, doc_comment string, held string, parent_name string, parent_kind string, parent_line int, parent_column int, depth int"
#: What is around a unit at the top of a file.
_TOP = (None, None, None, None, 0)
_SECTION = re.compile(r"<(template|script|style)\b[^>]*>(?s:.*?)</\1\s*>")
_DOCSTRING = re.compile(r"\s*[rRuUbB]{0,2}(\"\"\"|'''|\"|')((?s:.*?))(?<!\\)\1")
_ACCESSOR = re.compile(r"\{\s*(?:get|set|init)\b")
_LINES = Lexicon(blocks="line")
#: Attributes, annotations and template parameters before a declaration.
_BEFORE = re.compile(r"^(?:(?:@[\w.]+(?:\s*\([^()]*\))?|#!?\[[^\]]*\]|\[[\w(),\". =]+\]|template\s*<[^>]*>)\s+)+")
#: The sign at the end of a head that isn't part of its signature.
SIGN = re.compile(r" ?(?:\{(?: ?(?:get|set|init))?|;)$")
_ACCESS = re.compile(r"(public|private|protected)$")
#: Languages whose units end with their line, so that no ; is put behind them.
_NO_SIGN = ("go", "kotlin", "swift", "bash", "powershell", "python", "gdscript", "ruby", "lua", "sql")


def _read(language: str, text: str, heads: Heads | None = None) -> tuple[str, str, list[tuple[int, int]], list[Unit]]:
    """(code without strings and comments, without comments, comments, units) of one file; without a lexicon each line is a unit.

    With ``heads`` statements that declare nothing are left out of the units.
    """
    wanted, lines = (heads.declares, heads.lines) if heads else (None, None)
    if language not in LEXICONS and language != "vue":
        return text, text, [], [Unit(m.start(1), m.end(1), m.end(1), -1, False) for m in re.finditer(r"^[ \t]*(\S.*?)[ \t\r]*$", text, re.M)]
    if language != "vue":
        bare, code, comments = blank(text, LEXICONS[language])
        return bare, code, comments, units(bare, code, LEXICONS[language], wanted, lines)
    # a component's sections are units; scripts are read inside theirs
    bare = code = re.sub(r"[^\n]", " ", text)
    comments, out = [], []
    for m in _SECTION.finditer(text):
        head = m.start() + 1 + len(m.group(1))
        out.append(Unit(m.start(), head, m.end(), -1, True))
        code = code[: m.start()] + text[m.start() : head] + code[head:]
        if m.group(1) != "script":
            continue
        section, a, b = len(out) - 1, text.index(">", m.start()) + 1, text.rindex("</", m.start(), m.end())
        part, kept, notes = blank(text[a:b], LEXICONS["typescript"])
        bare, code = bare[:a] + part + bare[b:], code[:a] + kept + code[b:]
        comments += [(a + x, a + y) for x, y in notes]
        for u in units(part, kept, LEXICONS["typescript"]):
            out.append(Unit(a + u.start, a + u.head, a + u.end, section + 1 + u.parent if u.parent >= 0 else section, u.block, lead=u.lead))
    return bare, code, comments, out


def _documentation(text: str, bare: str, unit: Unit, comments: list[tuple[int, int]], ends: list[int], python: bool) -> str | None:
    """Comments right above a unit, on lines of their own; in Python the string that a block begins with."""
    if python and unit.block and not bare[unit.head : unit.head + 1].strip() and (m := _DOCSTRING.match(text, unit.head)) and m.start() < unit.end:
        return m.group(2).strip()
    if python:
        return None
    k, at, found = bisect_right(ends, unit.start) - 1, unit.start, []
    while k >= 0:
        a, b = comments[k]
        if text[b:at].strip() or text.count("\n", b, at) > 1 or bare[text.rfind("\n", 0, a) + 1 : a].strip():
            break
        found.append(text[a:b].rstrip())
        at, k = a, k - 1
    return "\n".join(reversed(found)) or None


_APART = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]")


def _anchored(pattern: re.Pattern[str]) -> bool:
    """Whether a pattern can only match at the beginning."""
    plain, before = _APART.sub("x", pattern.pattern), None
    while plain != before:
        before, plain = plain, re.sub(r"\([^()]*\)", "x", plain)
    return plain[:1] == "^" and plain[1:2] not in ("?", "*", "{") and "|" not in plain and "(" not in plain and not pattern.flags & (re.M | re.X)


def _any(patterns: list[re.Pattern[str]]) -> re.Pattern[str] | None:
    """A pattern that matches where one of these does, if they can be put together."""
    if all(_anchored(p) and p.flags == patterns[0].flags and not re.search(r"\\[1-9]|\(\?[P(a-zA-Z]", p.pattern) for p in patterns):
        return re.compile("|".join(f"(?:{p.pattern})" for p in patterns), patterns[0].flags)
    return None


class Heads:
    """Reads units' heads, which are often alike: (head on one line with a sign at its end for what the declarations look for, kind, name)."""

    def __init__(self, language: str, patterns: list[tuple[str, re.Pattern[str]]]) -> None:
        self.language, self.known = language, {}
        known = all(isinstance(p, re.Pattern) for _, p in patterns)
        self.patterns = [(k, p.match if known and _anchored(p) else p.search) for k, p in patterns]
        self.some = _any([p for _, p in patterns]) if known and patterns else None
        self.lexicon = LEXICONS["typescript"] if language == "vue" else LEXICONS.get(language, _LINES)
        self.brace = self.lexicon.blocks == "brace"
        self.closed = "" if language in _NO_SIGN else ";"
        self.lines = Lines()

    def read(self, code: str, u: Unit) -> tuple[str, str | None, str | None]:
        inside, sign = u.parent >= 0, ""
        if u.tail:
            sign = " " + " ".join(code[slice(*u.tail)].split()) + ";"
        elif self.brace:
            if u.block and (m := _ACCESSOR.match(code, u.head)):
                sign = " " + m.group()
            elif self.language != "vue" or inside:
                sign = " {" if u.block else self.closed
        return self._known((code[u.start : u.head], sign, u.lead, inside))

    def declares(self, text: str, lead: str, inside: bool) -> bool:
        """Whether a statement, which isn't a block and nothing stands behind, declares something or sets the access to it."""
        return self._known((text, (self.closed if self.brace else ""), lead, inside))[1] is not None

    def _known(self, key: tuple[str, str, str, bool]) -> tuple[str, str | None, str | None]:
        if (found := self.known.get(key)) is None:
            if len(self.known) >= KNOWN_HEADS:
                self.known.clear()
            found = self.known[key] = self._read(*key)
        return found

    def _read(self, text: str, sign: str, lead: str, inside: bool) -> tuple[str, str | None, str | None]:
        head = lead + _BEFORE.sub("", " ".join(text.split())) + sign
        if m := _ACCESS.match(head.rstrip(";")):
            return head, "access", m.group(1)
        line = " " + head if inside and not lead else head
        if self.some and not self.some.match(line):
            return head, None, None
        return head, *next(((k, m.group(1)) for k, find in self.patterns if (m := find(line)) and m.group(1)), (None, None))


def _rows(language: str, text: str, heads: Heads, read: tuple | None = None, documented: bool = True) -> Iterator[tuple]:
    """Blocks (without places), access labels and units that declare something; ``read`` is what ``_read`` gives, if that is known."""
    bare, code, comments, found = read or _read(language, text, heads)
    lines, ends = [0, *accumulate([len(x) + 1 for x in text.split("\n")])][:-1], [b for _, b in comments]
    plain = text.isascii()
    if not plain:
        size = [0]
        for a, b in zip(lines, lines[1:], strict=False):
            size.append(size[-1] + len(text[a:b].encode("utf-8", "surrogatepass")))

    def place(at: int) -> tuple[int, int, int]:
        line = bisect_right(lines, at) - 1
        return line + 1, at - lines[line], at if plain else size[line] + len(text[lines[line] : at].encode("utf-8", "surrogatepass"))

    for i, u in enumerate(found):
        head, kind, name = heads.read(code, u)
        if not name:
            if u.block:
                yield i, u.parent, True, 0, 0, 0, 0, 0, 0, None, None, None, None
        else:
            doc = _documentation(text, bare, u, comments, ends, language == "python") if documented and kind != "access" else None
            (a, b, c), (d, e, f) = place(u.start), place(u.end)
            yield i, u.parent, u.block, a, b, d, e, c, f, kind, name, head, doc


def batched(files: DataFrame, run, schema: str | StructType, *more: str) -> DataFrame:
    """mapInArrow over files (path, language, content and ``more`` columns) in small batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = files.sparkSession
    if int(spark.conf.get(key)) > BATCH_FILES:
        spark.conf.set(key, str(BATCH_FILES))
    return files.select("path", "language", "content", *more).mapInArrow(run, schema)


def _nested(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Units that declare something, as rows of _SYMBOLS after the language.

    Units come before those inside them, so one pass finds the nearest unit with a name around each; access labels hold
    for what follows them in the same unit.
    """
    above: dict[int, tuple] = {}  # of each unit with members: (name, kind, line, column, depth) of itself or of what has a name around it
    labels: dict[int, str] = {}
    for unit, parent, block, a, b, d, e, c, f, kind, name, head, doc in rows:
        if kind == "access":
            if parent >= 0:
                labels[parent] = name
            continue
        around = above.get(parent, _TOP)
        if name:
            yield kind, name, a, b, d, e, c, f, head, doc, labels.get(parent), *around
            above[unit] = (name, kind, a, b, around[4] + 1)
        elif block:
            above[unit] = around


def heads_of(declarations: dict[str, list[tuple[str, str]]]) -> dict[str, Heads]:
    return {n: Heads(n, [(k, re.compile(p, re.ASCII)) for k, p in rows]) for n, rows in declarations.items()}


def batcher(schema: str) -> Callable[[list[tuple]], pa.RecordBatch]:
    """What makes a batch of rows of strings and ints."""
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [pa.string() if t == "string" else pa.int32() for t in types]
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _declared(files: DataFrame, declarations: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Files (path, language, content) -> one row for each unit that declares something, with the unit with a name around it.

    kind and name are those of the first of its language's ``declarations`` that its head fits. Null contents have none.
    A file is one row and its units nest within it, so nothing has to be joined. The code of files is often much larger
    than what it was shuffled as: batches are cut by files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, batch = heads_of(declarations), batcher(_SYMBOLS)
        for b in batches:
            out: list[tuple] = []
            for path, language, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [(path, language, *r) for r in _nested(_rows(language, text or "", heads[language]))]
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return batched(files.where(F.col("language").isin(*declarations)), run, _SYMBOLS)


def code_of(language: str, text: str) -> str:
    """``text`` with the contents of strings and comments replaced by spaces, lines and columns as they were."""
    bare = blank(text, LEXICONS[language])[0] if language in LEXICONS else _read(language, text)[0] if language == "vue" else text
    return with_lines(bare, text)


def code_only(files: DataFrame) -> DataFrame:
    """``files`` with the contents of strings and comments replaced by spaces, lines and columns as they were; files of other languages as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [code_of(n, t or "") for n, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["path", "language", "content"])

    return batched(files, run, "path string, language string, content string")


def nested_symbols(files: DataFrame, declarations: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """``symbols`` with parent_name and depth, the number of symbols around each."""
    return described(_declared(files, extract.DECLARATIONS | (declarations or {})))


def kind_within(language: str, kind: str, name: str, parent_kind: str | None, parent_name: str | None) -> str:
    """The kind of a symbol by what is around it, as in ``described``."""
    if kind in ("method", "function"):
        if parent_kind in TYPES:
            return "constructor" if name == parent_name else kind
        return "function" if language not in ("go", "vue") else kind
    return kind


def described(named: DataFrame, *keep: str) -> DataFrame:
    """Rows of _SYMBOLS as ``nested_symbols``, with the columns of ``keep`` beside them."""
    ident = lambda name, line, column: F.md5(F.concat_ws(":", "path", name, (F.col(line) - 1).cast("string"), F.col(column).cast("string")))
    parent_id = F.when(F.col("parent_name").isNotNull(), ident("parent_name", "parent_line", "parent_column"))
    hidden, inside, shown = (F.col("head").rlike(rf"(?<![A-Za-z0-9_])({w})(?![A-Za-z0-9_])") for w in ("private|fileprivate", "protected", "public"))
    own = F.when(hidden | ((F.col("language") == "python") & F.col("name").rlike("^_")), "private").when(inside, "protected").when(shown, "public")
    visible = F.coalesce(own, "held", F.lit("public"))
    typed = F.coalesce(F.col("parent_kind").isin(*TYPES), F.lit(False))
    kind = F.when(typed & F.col("kind").isin("method", "function") & (F.col("name") == F.col("parent_name")), "constructor")
    kind = kind.when((F.col("kind") == "method") & ~typed & ~F.col("language").isin("go", "vue"), "function").otherwise(F.col("kind"))
    columns = ["start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte"]
    signature = F.trim(F.regexp_replace("head", SIGN.pattern, ""))
    return named.select(
        ident("name", "start_line", "start_column").alias("id"), "name", kind.alias("kind"), "language", F.col("path").alias("file_path"), *columns,
        signature.alias("signature"), "doc_comment", visible.alias("visibility"), parent_id.alias("parent_id"), "parent_name", "depth", *keep,
    )


def symbols(files: DataFrame, declarations: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Files (path, language, content) -> symbols with spans and parents.

    (id, name, kind, language, file_path, start_line, start_column, end_line, end_column, start_byte, end_byte, signature,
    doc_comment, visibility, parent_id). Lines count from 1, columns (characters) and bytes (UTF-8) from 0; ends are behind the last
    character. doc_comment is what is written right above, or Python's first string. parent_id is null at the top of a
    file. Methods are functions whose nearest named unit is a type. Languages without a lexicon (html, regex, razor and
    those that ``declarations`` adds) are read line by line, with spans of one line and no parents. Null contents and
    files of other languages have no symbols; rows that repeat a path are read each for itself, but their symbols share ids,
    so paths should be distinct.
    """
    return nested_symbols(files, declarations).drop("parent_name", "depth")
