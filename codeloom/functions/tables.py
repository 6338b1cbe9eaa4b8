"""Table functions for SQL: symbols, code units and stems of a file or text, called by LATERAL.

``register`` makes them known to a session under names of its own choice; ``declarations`` adds languages to those that
``symbols`` reads, so a session can extend its registry while it runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from codeloom.functions.stem import porter
from codeloom.operators import extract, structure
from codeloom.sources.workspace import LANGUAGES

_SIGN = re.compile(r" ?(?:\{(?: ?(?:get|set|init))?|;)$")
_COLUMNS = StructType()
for _name in ("name", "kind", "start_line", "start_column", "end_line", "end_column", "start_byte", "end_byte", "signature", "doc_comment", "parent"):
    _COLUMNS.add(_name, IntegerType() if _name.startswith(("start", "end")) else StringType())


def _symbols(declarations: dict[str, list[tuple[str, str]]], endings: dict[str, str]) -> type:
    class Symbols:
        """symbols(path, content[, language]): a row for each symbol of a file; the language is that of the path's ending if none is given."""

        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, language: AnalyzeArgument | None = None) -> AnalyzeResult:
            for name, a in (("path", path), ("content", content), ("language", language)):
                if a is not None and a.dataType.typeName() not in ("string", "void"):
                    raise ValueError(f"{name} must be a string, not {a.dataType.simpleString()}")
            if language is not None and language.isConstantExpression and language.value is not None and language.value not in declarations:
                raise ValueError(f"unknown language {language.value}; known are {', '.join(sorted(declarations))}")
            return AnalyzeResult(schema=_COLUMNS)

        def __init__(self) -> None:
            self.heads: dict[str, structure.Heads] = {}

        def eval(self, path: str, content: str, language: str | None = None) -> Iterator[tuple]:
            language = language or endings.get((path or "").rpartition(".")[2].lower())
            if language not in declarations:
                return
            if language not in self.heads:
                self.heads[language] = structure.Heads(language, [(k, re.compile(p, re.ASCII)) for k, p in declarations[language]])
            for kind, name, a, b, d, e, c, f, head, doc, _, parent, *_ in structure._nested(structure._rows(language, content or "", self.heads[language])):
                yield name, kind, a, b, d, e, c, f, _SIGN.sub("", head).strip(), doc, parent

    return Symbols


class Stems:
    """stems(text): (position, term, stem) of the text's terms of two characters or more."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, term in enumerate(t for t in re.split(r"[\s\W]+", (text or "").lower(), flags=re.ASCII) if len(t) > 1):
            yield i, term, porter(term)


def register(spark: SparkSession, declarations: dict[str, list[tuple[str, str]]] | None = None, endings: dict[str, str] | None = None, prefix: str = "") -> None:
    """Make ``symbols`` and ``stems`` (after ``prefix``) known to SQL. A call with more languages or endings replaces them."""
    known = {e.lstrip("."): n for n, es in LANGUAGES.items() for e in es}
    spark.udtf.register(f"{prefix}symbols", udtf(_symbols(extract.DECLARATIONS | (declarations or {}), known | (endings or {}))))
    spark.udtf.register(f"{prefix}stems", udtf(Stems, returnType="position int, term string, stem string"))
