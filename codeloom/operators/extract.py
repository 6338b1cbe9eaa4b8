"""Symbols, edges and types of source files, by declarations that stand at the beginning of a line.

Each language has a list of (kind, regular expression); a file's lines are tried against those of its language only,
with literal patterns, in the JVM. The first group of a pattern is the symbol's name. What needs a full grammar
(nested declarators, macros, multi-line headers) isn't found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values from here to HTML_KINDS: declarations of each language as (kind, pattern).
_ID = r"([A-Za-z_$][A-Za-z0-9_$]*)"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|readonly|open|data|inline|export|default|declare|const|unsafe|extern|synchronized|native|suspend|lateinit|external|mutating|fileprivate|required|convenience|inner|companion) +)*"
_C_TYPE = r"(?:[A-Za-z_][A-Za-z0-9_:<>,\[\]]*[ *&?]+)+"
_NOT_CONTROL = r"(?!(?:if|for|while|switch|return|else|catch|do|new|throw|using|lock|await|foreach|sizeof|case)\b)"

_ECMA = [
    ("class", rf"^\s*{_MODS}class +{_ID}"),
    ("function", rf"^\s*{_MODS}function\s*\*? *{_ID}"),
    ("function", rf"^\s*(?:export +)?(?:const|let|var) +{_ID} *(?::[^=]+)?= *(?:async +)?(?:\([^)]*\)|[A-Za-z_$][\w$]*) *(?::[^=]+)?=>"),
    ("variable", rf"^\s*(?:export +)?(?:const|let|var) +{_ID} *(?:[:=;]|$)(?!.*=>)"),
    ("import", r"""^\s*import\b.*?['"]([^'"]+)['"]"""),
    ("export", r"""^\s*export\b *(?:type +)?(?:\*|\{).*?from *['"]([^'"]+)['"]"""),
    ("export", r"^\s*export *\{ *([\w$]+)"),
    ("method", rf"^\s+{_MODS}(?:get +|set +|\*)?{_NOT_CONTROL}{_ID} *\([^)]*\) *(?::[^{{]+)?\{{"),
]
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": _ECMA,
    "typescript": [
        *_ECMA,
        ("interface", rf"^\s*{_MODS}interface +{_ID}"),
        ("type", rf"^\s*{_MODS}type +{_ID}(?:<[^=]*>)? *="),
        ("enum", rf"^\s*{_MODS}enum +{_ID}"),
        ("namespace", rf"^\s*{_MODS}(?:namespace|module) +{_ID}"),
        ("property", rf"^\s+(?:(?:public|private|protected|static|readonly) +)+{_ID}[?!]? *[:=;]"),
    ],
    "qmljs": [*_ECMA, ("class", r"^\s*([A-Z][A-Za-z0-9_.]*) *\{"), ("property", rf"^\s*(?:readonly +|default +)?property +\S+ +{_ID}"), ("function", rf"^\s*signal +{_ID}"), ("import", r"^\s*import +([A-Za-z][A-Za-z0-9_.]*)")],
    "vue": [
        ("class", r"^<(template|script|style)\b"),
        ("function", rf"^\s*(?:async +)?function +{_ID}"),
        ("function", rf"^\s*const +{_ID} *= *(?:async *)?\("),
        ("method", rf"^ +(?:async +)?{_NOT_CONTROL}{_ID} *\([^)]*\) *\{{"),
        ("property", rf"^\s*const +{_ID} *= *(?:ref|computed|reactive)\b"),
    ],
    "python": [
        ("class", r"^\s*class +([A-Za-z_]\w*)"),
        ("function", r"^(?:async +)?def +([A-Za-z_]\w*)"),
        ("method", r"^\s+(?:async +)?def +([A-Za-z_]\w*)"),
        ("constant", r"^([A-Z][A-Z0-9_]+) *(?::[^=]+)?=(?!=)"),
        ("variable", r"^([a-z_]\w*) *(?::[^=]+)?=(?!=)"),
        ("import", r"^\s*from +(\S+) +import"),
        ("import", r"^\s*import +([\w.]+)"),
    ],
    "java": [
        ("namespace", r"^\s*package +([\w.]+)"),
        ("import", r"^\s*import +(?:static +)?([\w.*]+)"),
        ("class", rf"^\s*{_MODS}(?:class|record) +{_ID}"),
        ("interface", rf"^\s*{_MODS}@?interface +{_ID}"),
        ("enum", rf"^\s*{_MODS}enum +{_ID}"),
        ("constructor", rf"^\s+(?:public|private|protected) +{_ID} *\("),
        ("method", rf"^\s+{_MODS}{_NOT_CONTROL}{_C_TYPE}{_ID} *\([^;]*\)[^;]*\{{"),
        ("property", rf"^\s+(?:public|private|protected) +{_MODS}{_C_TYPE}{_ID} *[=;]"),
    ],
    "c_sharp": [
        ("import", r"^\s*using +(?:static +)?([\w.]+) *;"),
        ("namespace", r"^\s*namespace +([\w.]+)"),
        ("class", rf"^\s*{_MODS}(?:class|record) +{_ID}"),
        ("interface", rf"^\s*{_MODS}interface +{_ID}"),
        ("struct", rf"^\s*{_MODS}struct +{_ID}"),
        ("enum", rf"^\s*{_MODS}enum +{_ID}"),
        ("delegate", rf"^\s*{_MODS}delegate +\S+ +{_ID}"),
        ("event", rf"^\s*{_MODS}event +\S+ +{_ID}"),
        ("constructor", rf"^\s+(?:public|private|protected|internal) +{_ID} *\("),
        ("property", rf"^\s+{_MODS}{_NOT_CONTROL}{_C_TYPE}{_ID} *(?:\{{ *(?:get|set|init)|=>)"),
        ("method", rf"^\s+{_MODS}{_NOT_CONTROL}{_C_TYPE}{_ID}(?:<[^>]*>)? *\([^;]*\) *(?:\{{|=>|$)"),
        ("field", rf"^\s+(?:public|private|protected|internal) +{_MODS}{_C_TYPE}{_ID} *[=;]"),
    ],
    "razor": [("import", r"^\s*@using +([\w.]+)"), ("class", r"^\s*@(?:inherits|model) +([\w.<>]+)"), ("property", r"^\s*@(?:inject) +\S+ +(\w+)"), ("method", rf"^\s*(?:private|public|protected) +{_MODS}{_C_TYPE}{_ID} *\("), ("module", r'^\s*@page +"([^"]*)"')],
    "c": [
        ("import", r'^\s*#\s*include +[<"]([^>"]+)[>"]'),
        ("constant", r"^\s*#\s*define +([A-Za-z_]\w*)"),
        ("class", r"^\s*(?:typedef +)?(?:struct|union) +([A-Za-z_]\w*) *\{?\s*$"),
        ("enum", r"^\s*(?:typedef +)?enum +([A-Za-z_]\w*)"),
        ("type", r"^\s*typedef\b.*?([A-Za-z_]\w*) *;"),
        ("function", rf"^{_NOT_CONTROL}(?:static +|inline +|extern +)*{_C_TYPE}{_ID} *\([^;]*\)? *\{{?\s*$"),
        ("variable", rf"^(?:static +|extern +|const +)*(?:int|char|float|double|long|short|unsigned|bool|size_t)\b[ *\w]*?{_ID} *(?:\[[^\]]*\])? *[=;]"),
    ],
    "cpp": [
        ("import", r'^\s*#\s*include +[<"]([^>"]+)[>"]'),
        ("constant", r"^\s*#\s*define +([A-Za-z_]\w*)"),
        ("namespace", r"^\s*namespace +([A-Za-z_][\w:]*)"),
        ("class", r"^\s*(?:template *<[^>]*> *)?class +([A-Za-z_]\w*)"),
        ("struct", r"^\s*(?:template *<[^>]*> *)?struct +([A-Za-z_]\w*)"),
        ("union", r"^\s*union +([A-Za-z_]\w*)"),
        ("enum", r"^\s*enum +(?:class +|struct +)?([A-Za-z_]\w*)"),
        ("destructor", r"^\s*(?:virtual +)?(~[A-Za-z_]\w*) *\("),
        ("operator", r"^\s*.*\b(operator *[^\s\w(]+) *\("),
        ("function", rf"^{_NOT_CONTROL}(?:static +|inline +|constexpr +)*{_C_TYPE}([A-Za-z_][\w:]*) *\([^;]*\)[^;]*\{{?\s*$"),
        ("method", rf"^\s+{_NOT_CONTROL}(?:virtual +|static +|inline +|explicit +)*{_C_TYPE}{_ID} *\([^)]*\)"),
        ("method", rf"^\s+{_NOT_CONTROL}(?:inline +|explicit +|constexpr +)*{_ID} *\([^;]*\)[^;]*\{{"),
    ],
    "go": [
        ("namespace", r"^package +(\w+)"),
        ("import", r'^(?:import +|\s+)(?:\w+ +)?"([\w./-]+)"\s*$'),
        ("class", r"^type +(\w+)(?:\[[^\]]*\])? +struct\b"),
        ("interface", r"^type +(\w+)(?:\[[^\]]*\])? +interface\b"),
        ("type", r"^type +(\w+) +(?!struct\b|interface\b)\S"),
        ("method", r"^func +\([^)]*\) *(\w+)"),
        ("function", r"^func +(\w+)"),
        ("constant", r"^const +(\w+)"),
        ("variable", r"^var +(\w+)"),
    ],
    "rust": [
        ("import", r"^\s*(?:pub +)?use +([\w:]+)"),
        ("namespace", r"^\s*(?:pub(?:\([^)]*\))? +)?mod +(\w+)"),
        ("class", r"^\s*(?:pub(?:\([^)]*\))? +)?(?:struct|enum) +(\w+)"),
        ("union", r"^\s*(?:pub +)?union +(\w+)"),
        ("interface", r"^\s*(?:pub(?:\([^)]*\))? +)?(?:unsafe +)?trait +(\w+)"),
        ("function", r"^(?:pub(?:\([^)]*\))? +)?(?:(?:async|const|unsafe|extern(?: +\"[^\"]*\")?) +)*fn +(\w+)"),
        ("method", r"^\s+(?:pub(?:\([^)]*\))? +)?(?:(?:async|const|unsafe) +)*fn +(\w+)"),
        ("type", r"^\s*(?:pub(?:\([^)]*\))? +)?type +(\w+)"),
        ("constant", r"^\s*(?:pub(?:\([^)]*\))? +)?const +(\w+) *:"),
        ("variable", r"^\s*(?:pub(?:\([^)]*\))? +)?static +(?:mut +)?(\w+)"),
        ("function", r"^\s*macro_rules! *(\w+)"),
    ],
    "ruby": [
        ("import", r"""^\s*require(?:_relative)? +['"]([^'"]+)['"]"""),
        ("module", r"^\s*module +([A-Z][\w:]*)"),
        ("class", r"^\s*class +([A-Z][\w:]*)"),
        ("constructor", r"^\s*def +(initialize)\b"),
        ("method", r"^\s*def +(?:self\.)?(?!initialize\b)([A-Za-z_]\w*[?!=]?)"),
        ("property", r"^\s*attr_(?:reader|writer|accessor) +:(\w+)"),
        ("constant", r"^\s*([A-Z][A-Z0-9_]*) *=(?!=)"),
        ("variable", r"^\s*(@{1,2}\w+) *=(?!=)"),
    ],
    "php": [
        ("namespace", r"^\s*namespace +([\w\\]+)"),
        ("import", r"^\s*use +([\w\\]+)"),
        ("class", rf"^\s*{_MODS}class +{_ID}"),
        ("interface", rf"^\s*interface +{_ID}"),
        ("trait", rf"^\s*trait +{_ID}"),
        ("enum", rf"^\s*enum +{_ID}"),
        ("constructor", r"^\s*(?:public +|private +|protected +)?function +(__construct)\b"),
        ("function", rf"^\s*{_MODS}function +&?(?!__construct\b){_ID}"),
        ("constant", rf"^\s*{_MODS}(?:const|define\(['\"]) *{_ID}"),
        ("property", r"^\s*(?:(?:public|private|protected|static|readonly) +)+(?:\??[\w\\|]+ +)?\$(\w+)"),
        ("variable", r"^\$(\w+) *="),
    ],
    "swift": [
        ("import", r"^\s*import +(\w+)"),
        ("class", rf"^\s*{_MODS}(?:class|actor|extension) +(?!func\b|var\b){_ID}"),
        ("struct", rf"^\s*{_MODS}struct +{_ID}"),
        ("interface", rf"^\s*{_MODS}protocol +{_ID}"),
        ("enum", rf"^\s*{_MODS}(?:indirect +)?enum +{_ID}"),
        ("enum_member", r"^\s*case +(\w+)(?![^(=,]*:)"),
        ("constructor", rf"^\s*{_MODS}(init)[?!]?\s*[(<]"),
        ("destructor", r"^\s*(deinit)\b"),
        ("function", rf"^{_MODS}func +{_ID}"),
        ("method", rf"^\s+(?:@\w+ +)*{_MODS}(?:class +)?func +{_ID}"),
        ("property", rf"^\s+(?:@\w+ +)*{_MODS}(?:let|var) +{_ID}"),
        ("variable", rf"^(?:let|var) +{_ID}"),
        ("type", rf"^\s*{_MODS}typealias +{_ID}"),
    ],
    "kotlin": [
        ("namespace", r"^\s*package +([\w.]+)"),
        ("import", r"^\s*import +([\w.*]+)"),
        ("enum", rf"^\s*{_MODS}enum +class +{_ID}"),
        ("class", rf"^\s*(?!.*\benum +class){_MODS}(?:annotation +|value +)?(?:class|object) +{_ID}"),
        ("interface", rf"^\s*{_MODS}(?:fun +)?interface +{_ID}"),
        ("function", rf"^{_MODS}fun +(?:<[^>]*> *)?(?:[\w<>?]+\.)?{_ID} *\("),
        ("method", rf"^\s+{_MODS}fun +(?:<[^>]*> *)?(?:[\w<>?]+\.)?{_ID} *\("),
        ("property", rf"^\s*{_MODS}va[lr] +{_ID}"),
        ("type", rf"^\s*{_MODS}typealias +{_ID}"),
    ],
    "dart": [
        ("import", r"""^\s*(?:import|export) +['"]([^'"]+)['"]"""),
        ("class", rf"^\s*{_MODS}(?:class|mixin|extension) +{_ID}"),
        ("enum", rf"^\s*enum +{_ID}"),
        ("function", rf"^{_NOT_CONTROL}{_C_TYPE}{_ID} *\([^;]*\) *(?:async\*? *)?(?:\{{|=>)"),
        ("method", rf"^\s+(?:static +)?{_NOT_CONTROL}{_C_TYPE}{_ID} *\([^;]*\) *(?:async\*? *)?(?:\{{|=>)"),
        ("field", rf"^\s+(?:static +|late +|final +|const +)+(?:[\w<>?,]+ +)?{_ID} *[=;]"),
        ("variable", rf"^(?:final|var|const) +(?:[\w<>?]+ +)?{_ID} *="),
    ],
    "sql": [
        ("class", r'(?i)^\s*create +(?:or +replace +)?(?:temp(?:orary)? +)?table +(?:if +not +exists +)?["`\[]?([\w.]+)'),
        ("interface", r'(?i)^\s*create +(?:or +replace +)?(?:materialized +)?view +(?:if +not +exists +)?["`\[]?([\w.]+)'),
        ("function", r'(?i)^\s*create +(?:or +replace +)?(?:function|procedure) +["`\[]?([\w.]+)'),
        ("method", r'(?i)^\s*create +(?:or +replace +)?trigger +["`\[]?([\w.]+)'),
        ("property", r'(?i)^\s*create +(?:unique +)?index +(?:if +not +exists +)?["`\[]?([\w.]+)'),
        ("namespace", r'(?i)^\s*create +schema +(?:if +not +exists +)?["`\[]?([\w.]+)'),
        ("field", r'(?i)^\s+["`\[]?(?!constraint\b|primary\b|foreign\b|unique\b|check\b)([a-z_]\w*)["`\]]? +(?:int|integer|bigint|smallint|serial|bigserial|varchar|char|text|date|timestamp|timestamptz|boolean|bool|decimal|numeric|real|double|float|json|jsonb|uuid|blob|bytea)\b'),
        ("variable", r"(?i)^\s*(?:with +|, *)([a-z_]\w*) +as *\("),
    ],
    "bash": [("function", r"^\s*function +([\w-]+)"), ("function", r"^\s*([\w-]+) *\(\) *\{?"), ("constant", r"^\s*(?:readonly|declare +-r) +([A-Za-z_]\w*)"), ("variable", r"^\s*(?:export +|local +|declare +(?:-\w+ +)?)?([A-Za-z_]\w*)=")],
    "powershell": [("function", r"(?i)^\s*function +([\w:-]+)"), ("class", r"(?i)^\s*class +(\w+)"), ("enum", r"(?i)^\s*enum +(\w+)"), ("import", r"(?i)^\s*(?:import-module|using +module) +(\S+)"), ("method", r"^\s+(?:static +|hidden +)?\[[\w.\[\]]+\] *(\w+) *\("), ("variable", r"^\s*(?:\[[\w.\[\]]+\] *)?\$((?:\w+:)?\w+) *=")],
    "lua": [("function", r"^\s*(?:local +)?function +([\w.]+) *\("), ("method", r"^\s*function +(\w+:\w+)"), ("function", r"^\s*(?:local +)?([\w.]+) *= *function\b"), ("import", r"""^\s*local +\w+ *= *require *\(? *['"]([^'"]+)"""), ("variable", r"^\s*local +(\w+) *=(?! *function| *require)")],
    "gdscript": [("class", r"^\s*class_name +(\w+)"), ("class", r"^\s*class +(\w+)"), ("constructor", r"^\s*(?:static +)?func +(_init)\b"), ("function", r"^\s*(?:static +)?func +(?!_init\b)(\w+)"), ("event", r"^\s*signal +(\w+)"), ("enum", r"^\s*enum +(\w+)"), ("constant", r"^\s*const +(\w+)"), ("field", r"^\s*(?:@\w+(?:\([^)]*\))? +)*(?:onready +|export +)?var +(\w+)")],
    "zig": [("struct", r"^\s*(?:pub +)?const +(\w+) *= *(?:extern +|packed +)?struct\b"), ("enum", r"^\s*(?:pub +)?const +(\w+) *= *enum\b"), ("class", r"^\s*(?:pub +)?const +(\w+) *= *union\b"), ("constant", r"^\s*(?:pub +)?const +(\w+)\b(?!.*= *(?:extern +|packed +)?(?:struct|enum|union)\b)"), ("variable", r"^\s*(?:pub +)?var +(\w+)"), ("function", r"^(?:pub +|export +|inline +)*fn +(\w+)"), ("method", r"^\s+(?:pub +|inline +)*fn +(\w+)"), ("function", r'^test +"([^"]+)"')],
    "css": [("import", r"""^\s*@import +(?:url\()?['"]?([^'")]+)"""), ("function", r"^\s*@(?:keyframes|mixin|function) +([\w-]+)"), ("property", r"^\s*(--[\w-]+) *:"), ("variable", r"^\s*([$@][\w-]+) *:"), ("class", r"^\s*([.#&:*a-zA-Z\[][^{};@]*?) *[{,]\s*$")],
    "regex": [("class", r"^(?!\s*#)\s*(\S.*?)\s*$"), ("variable", r"\(\?<([A-Za-z_]\w*)>"), ("constant", r"\\([1-9])")],
    "html": [("class", r"<([a-zA-Z][a-zA-Z0-9-]*)")],
}
FORM_FIELDS = ("input", "textarea", "select", "button", "fieldset", "legend", "label")
MEDIA = ("img", "video", "audio", "picture", "source", "track")
#: Kinds of edges by the attribute that they come from.
HTML_EDGES = {"href": "references", "src": "uses", "action": "calls"}
_TYPES = {
    "python": r"->\s*([\w.\[\], |]+)|^\s*\w+\s*:\s*([\w.\[\], |]+?)\s*=",
    "typescript": r"\)\s*:\s*([\w.<>\[\]| ]+?)\s*[{=]|^\s*\S.*?\w[?!]?\s*:\s*([\w.<>\[\]| ]+?)\s*[=;]",
    "rust": r"->\s*([\w:<>&', ]+?)\s*(?:\{|where|$)|:\s*([\w:<>&', ]+?)\s*=",
    "go": r"\)\s*([\w.*\[\]]+)\s*\{|^var\s+\w+\s+([\w.*\[\]]+)",
    "kotlin": r"\)\s*:\s*([\w.<>?]+)|va[lr]\s+\w+\s*:\s*([\w.<>?]+)",
    "swift": r"->\s*([\w.<>?\[\]]+)|(?:let|var)\s+\w+\s*:\s*([\w.<>?\[\]]+)",
    "java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*([\w.<>\[\]]+)\s+\w+\s*[(=;]()",
    "c_sharp": r"^\s*(?:(?:public|private|protected|internal|static|readonly|async|virtual|override)\s+)*([\w.<>\[\]?]+)\s+\w+\s*[({=;]()",
}
_INHERITS = {
    "python": r"^\s*class +(\w+) *\(([^)]*)\)",
    "java": r"class +(\w+).*?\b(?:extends|implements) +([^{]*)",
    "javascript": r"class +(\w+) +extends +([\w.]+)",
    "typescript": r"class +(\w+).*?\b(?:extends|implements) +([^{]*)",
    "c_sharp": r"(?:class|struct|interface) +(\w+)(?:<[^>]*>)? *: *([^{]*)",
    "kotlin": r"class +(\w+)(?:\([^)]*\))? *: *([^{]*)",
    "swift": r"(?:class|struct|enum) +(\w+) *: *([^{]*)",
    "cpp": r"(?:class|struct) +(\w+) *: *([^{]*)",
    "ruby": r"^\s*class +(\w+) *< *([\w:]+)",
    "php": r"class +(\w+).*?\b(?:extends|implements) +([^{]*)",
    "rust": r"impl(?:<[^>]*>)? +(?:\w+::)*(\w+)(?:<[^>]*>)? +for +(\w+)",
    "dart": r"class +(\w+).*?\b(?:extends|implements|with) +([^{]*)",
}
_CALL = r"([A-Za-z_]\w*) *\("
_KEYWORDS = ("if", "for", "while", "switch", "return", "catch", "function", "def", "fn", "func", "sizeof", "elif", "and", "or", "not", "in", "print", "await", "new", "super", "class")


def _by_language(language: Column, tables: dict[str, object], make) -> Column:
    out = None
    for name, value in tables.items():
        out = F.when(language == name, make(value)) if out is None else out.when(language == name, make(value))
    return out


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, language, line, text), lines from 1."""
    rows = files.select("path", "language", F.posexplode(F.split("content", "\r?\n")).alias("i", "text"))
    return rows.select("path", "language", (F.col("i") + 1).alias("line"), "text")


def symbols(files: DataFrame, declarations: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Files (path, language, content) -> symbols (id, name, kind, language, file_path, start_line, start_column, signature, doc_comment, visibility).

    A line declares one symbol at most: that of the first of its language's patterns that fits. Pass more
    ``declarations`` to register languages. start_column is from 0, start_line from 1.
    """
    tables = DECLARATIONS | (declarations or {})

    def first_of(patterns: list[tuple[str, str]]) -> Column:
        tries = []
        for kind, p in patterns:
            name = F.regexp_extract("text", p, 1)
            tries.append(F.when(name != "", F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
        return F.coalesce(*tries)

    lines = numbered_lines(files.where(F.col("language").isin(list(tables))))
    rows = lines.withColumn("s", _by_language(F.col("language"), tables, first_of)).where("s is not null")
    rows = rows.withColumn("_n", F.col("s.name"))
    column = F.position(F.col("_n"), F.col("text")) - 1
    visible = F.when(F.col("text").rlike(r"(?<![A-Za-z0-9_])(private|fileprivate)(?![A-Za-z0-9_])"), "private").when(F.col("text").rlike(r"(?<![A-Za-z0-9_])protected(?![A-Za-z0-9_])"), "protected").otherwise("public")
    ident = F.md5(F.concat_ws(":", "path", "_n", (F.col("line") - 1).cast("string"), column.cast("string")))
    return rows.select(
        ident.alias("id"), F.col("_n").alias("name"), F.col("s.kind").alias("kind"), "language", F.col("path").alias("file_path"),
        F.col("line").alias("start_line"), column.cast("int").alias("start_column"), F.trim("text").alias("signature"), visible.alias("visibility"),
    )


def inferred_types(found: DataFrame) -> DataFrame:
    """(symbol_id, resolved_type) of the symbols whose signature tells their type."""

    def one(pattern: str) -> Column:
        a, b = (F.regexp_extract("signature", pattern, i) for i in (1, 2))
        return F.nullif(F.trim(F.when(a != "", a).otherwise(b)), F.lit(""))

    rows = found.where(F.col("kind").isin("function", "method", "variable", "property", "field", "constant"))
    return rows.select(F.col("id").alias("symbol_id"), "language", _by_language(F.col("language"), _TYPES, one).alias("resolved_type")).where("resolved_type is not null")


def inheritance(files: DataFrame, found: DataFrame) -> DataFrame:
    """(from_id, to_name, to_id, kind, file_path, line): what a type extends or implements; to_id if the file declares it."""

    def pairs(pattern: str) -> Column:
        return F.struct(F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("bases"))

    lines = numbered_lines(files.where(F.col("language").isin(list(_INHERITS))))
    rows = lines.withColumn("p", _by_language(F.col("language"), _INHERITS, pairs)).where("p.name <> ''")
    rust = F.col("language") == "rust"  # the trait comes first there
    rows = rows.select("path", "line", "language", F.when(rust, F.col("p.bases")).otherwise(F.col("p.name")).alias("name"), F.when(rust, F.col("p.name")).otherwise(F.col("p.bases")).alias("bases"))
    names = F.split(F.regexp_replace("bases", r"<[^>]*>|\([^)]*\)|(?<![A-Za-z0-9_])(?:public|private|protected|virtual|extends|implements|with)(?![A-Za-z0-9_])", ","), r"[,\s]+")
    rows = rows.select("path", "line", "name", F.explode(F.filter(names, lambda x: x.rlike(r"^[A-Za-z_][\w.:]*$"))).alias("to_name"))
    s = found.where(F.col("kind").isin("class", "interface", "struct", "trait", "enum")).groupBy("file_path", "name").agg(F.min_by(F.struct("id", "kind"), "start_line").alias("s"))
    here = s.select(F.col("file_path").alias("path"), "name", F.col("s.id").alias("from_id"))
    there = s.select(F.col("file_path").alias("path"), F.col("name").alias("to_name"), F.col("s.id").alias("to_id"), F.col("s.kind").alias("to_kind"))
    out = rows.join(here, ["path", "name"]).join(there, ["path", "to_name"], "left")
    kind = F.when(F.col("to_kind").isin("interface", "trait"), "implements").otherwise("extends")
    return out.select("from_id", "to_name", "to_id", kind.alias("kind"), F.col("path").alias("file_path"), "line")


def call_edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, file_path, line): calls of functions that the file declares, from the declaration before the line."""
    functions = found.where(F.col("kind").isin("function", "method", "constructor"))
    lines = numbered_lines(files).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(_CALL), F.lit(1))).alias("name"))
    lines = lines.where(~F.col("name").isin(*_KEYWORDS))
    targets = functions.groupBy("file_path", "name").agg(F.min_by("id", "start_line").alias("to_id"), F.min("start_line").alias("at"))
    uses = lines.join(targets.withColumnRenamed("file_path", "path"), ["path", "name"]).where("line <> at")
    marks = functions.groupBy(F.col("file_path").alias("path"), F.col("start_line").alias("line")).agg(F.min("id").alias("owner"))
    both = uses.select("path", "line", "to_id", F.lit(None).cast("string").alias("owner")).unionByName(marks.select("path", "line", F.lit(None).cast("string").alias("to_id"), "owner"))
    last = F.last("owner", ignorenulls=True).over(Window.partitionBy("path").orderBy("line", F.col("to_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("from_id", last).where("to_id is not null and from_id is not null")
    return out.select("from_id", "to_id", F.lit("calls").alias("kind"), F.col("path").alias("file_path"), "line")


def html_tags(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, tag, kind, attributes): opening tags in order; attributes as they are written."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*[^>]*)>"), F.lit(1))
    rows = pages.select(key, F.posexplode(tags).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^([a-zA-Z][a-zA-Z0-9-]*)", 1))
    rows = rows.withColumn("tag", tag).withColumn("attributes", F.trim(F.regexp_replace("raw", r"^[a-zA-Z][a-zA-Z0-9-]*", "")))
    sheet = (F.col("tag") == "link") & F.contains(F.lower("attributes"), F.lit("stylesheet"))
    kind = F.when(F.col("tag") == "meta", "property").when(sheet, "import").when(F.col("tag").isin("script", "style"), "variable")
    kind = kind.when(F.col("tag").isin(*FORM_FIELDS), "field").when(F.col("tag").isin(*MEDIA), "variable").otherwise("class")
    return rows.select(key, "pos", "tag", kind.alias("kind"), "attributes")


def html_links(tags: DataFrame, key: str) -> DataFrame:
    """(key, pos, tag, attribute, target, kind): edges by href, src and action attributes."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(k).alias("kind"), F.regexp_extract("attributes", rf'(?:^|\s){a}="([^"]*)"', 1).alias("target")) for a, k in HTML_EDGES.items()]))
    return tags.select(key, "pos", "tag", each.alias("e")).select(key, "pos", "tag", "e.attribute", "e.target", "e.kind").where("target <> ''")


def html_attributes(tags: DataFrame, key: str) -> DataFrame:
    """(key, pos, tag, name): names of the attributes with a quoted value."""
    names = F.regexp_extract_all("attributes", F.lit(r'([a-zA-Z][a-zA-Z0-9-]*)="[^"]*"'), F.lit(1))
    return tags.select(key, "pos", "tag", F.explode(names).alias("name"))
