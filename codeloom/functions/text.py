"""Column functions on names, source text and paths. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \b knows Unicode while its \w does not, so word edges are spelt out.
_EDGE_L, _EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Quoted strings are matched without a loop over single characters, which would be deep recursion on long ones.
_COMMENTS_AND_STRINGS = (r"(?s)/\*.*?\*/", r"//[^\n]*", *[rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+{q}" for q in "'\"`"])
_CODE_TERMS = (
    rf"{_EDGE_L}[a-zA-Z][a-zA-Z0-9]++{_EDGE_R}",
    rf"{_EDGE_L}[a-z]+(?:_[a-z]+)+{_EDGE_R}",
    rf"{_EDGE_L}[a-z]+(?:-[a-z]+)+{_EDGE_R}",
    r"[+\-*/=<>!&|]{2,}+",
)
# Words that are not terms.
NOISE = ("var", "let", "const")
# Layers and the parts of a path that show them, in the order they are tried.
LAYERS = (
    ("frontend", ("frontend", "client", "ui")),
    ("api", ("api", "controller", "endpoint")),
    ("domain", ("domain", "model", "entity")),
    ("data", ("data", "repository", "dal")),
    ("database", ("database", ".sql", "migration")),
    ("infrastructure", ("infrastructure", "config")),
)
# The same by directory; the rest is infrastructure.
DIRECTORY_LAYERS = (
    ("api", ("/api/", "/routes/", "/controllers/")),
    ("data", ("/db/", "/database/", "/models/")),
    ("frontend", ("/ui/", "/components/", "/views/")),
    ("domain", ("/service/", "/business/", "/domain/")),
)
# Tags and the parts of a lower-case name that show them.
NAME_TAGS = (
    ("dto", ("dto", "data")),
    ("repository", ("repository", "repo")),
    ("service", ("service", "svc")),
    ("controller", ("controller", "ctrl")),
    ("entity", ("entity", "model")),
)
# Display names of patterns and what a name or kind must hold.
PATTERN_NAMES = (
    ("Data Transfer Object", "dto"),
    ("Repository Pattern", "repository"),
    ("Service Layer", "service"),
    ("Controller Pattern", "controller"),
)


def simple_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores of two characters or more."""
    return F.filter(F.split(F.lower(text), r"[\s\W]+"), lambda x: F.length(x) > 1)


def code_tokens(text: Column) -> Column:
    """Distinct lower-case parts of a name: generics with and without arguments, camel case, separated words."""
    parts = F.flatten(F.array(
        F.regexp_extract_all(text, F.lit(r"(\w+<[^>]+>)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(\w+)<[^>]+>"), F.lit(1)),
        F.split(text, r"(?=[A-Z])|[_\-\s]+"),
        F.split(text, r"[^A-Za-z0-9]+"),
        F.array(text),
    ))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: F.length(x) > 1))


def code_terms(text: Column) -> Column:
    """Distinct lower-case terms of source text without comments and strings: names, joined names, operators."""
    none = F.array().cast("array<string>")
    # patterns of rare terms are only tried on texts that hold their mark
    marks = (F.lit(True), lambda t: F.contains(t, F.lit("_")), lambda t: t.rlike("[a-z]-[a-z]"), lambda t: t.rlike("[+\\-*/=<>!&|]{2}"))

    def terms(plain: Column) -> Column:
        found = [F.when(mark if isinstance(mark, Column) else mark(plain), F.regexp_extract_all(plain, F.lit(p), F.lit(0))).otherwise(none) for p, mark in zip(_CODE_TERMS, marks)]
        return F.filter(F.transform(F.array_distinct(F.flatten(F.array(*found))), F.lower), lambda x: ~x.isin(*NOISE))

    plain = reduce(lambda t, p: F.when(F.contains(t, F.lit(p[1])), F.regexp_replace(t, p[0], " ")).otherwise(t), zip(_COMMENTS_AND_STRINGS, ("/*", "//", "'", '"', "`")), text)
    # one-element array: the plain text is worked out once
    return F.array_distinct(F.flatten(F.transform(F.array(plain), terms)))


def like_literal(value: str) -> str:
    """``value`` with LIKE's wildcards escaped."""
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ignoring_case(column: Column, value: str) -> Column:
    return F.contains(F.lower(column), F.lit(value.lower()))


def match_rank(name: Column, query: str) -> Column:
    """1 for the exact name, 2 for a beginning (in any case), 3 for the rest."""
    return F.when(name == query, 1).when(F.startswith(F.lower(name), F.lit(query.lower())), 2).otherwise(3)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in lower case; 1 if both are empty."""
    a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def spaced_camel(name: Column) -> Column:
    """A space before each capital."""
    return F.regexp_replace(name, "([A-Z])", " $1")


def camel_match(a: Column, b: Column) -> Column:
    """0.7 if one name taken apart at its capitals holds the other, else 0."""
    x, y = (F.lower(F.trim(spaced_camel(c))) for c in (a, b))
    return F.when(F.contains(x, y) | F.contains(y, x), 0.7).otherwise(0.0)


def name_similarity(name: Column, query: Column) -> Column:
    """1 if equal but for case, 0.8 if one holds the other, else the better of edits and capitals."""
    a, b = F.lower(name), F.lower(query)
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(a == b, 1.0).when(inside, 0.8).otherwise(F.greatest(edit_similarity(a, b), camel_match(name, query)))


def structural_score(kind: Column, path: Column, language: Column, lines: Column, query: str) -> Column:
    """0.5 and bonuses for a query that names the kind, the path or the language, and for long symbols; 1 at most."""
    q = F.lit(query.lower())
    bonus = lambda hit, n: F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0.0)
    total = 0.5 + bonus(F.contains(q, F.lower(kind)), 0.2) + bonus(F.contains(F.lower(path), q), 0.15)
    total = total + bonus(F.contains(q, F.lower(language)), 0.1) + F.least(F.lit(0.05), F.coalesce(lines, F.lit(0)) / 100)
    return F.least(F.lit(1.0), total)


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def layer(path: Column) -> Column:
    """The first of LAYERS that a part of the path shows, or unknown."""
    low = F.lower(path)
    return F.coalesce(*[F.when(_holds(low, parts), F.lit(name)) for name, parts in LAYERS], F.lit("unknown"))


def directory_layer(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(*[F.when(_holds(low, parts), F.lit(name)) for name, parts in DIRECTORY_LAYERS], F.lit("infrastructure"))


def pattern_tags(name: Column, kind: Column) -> Column:
    """Tags of a symbol by its name and kind."""
    low = F.lower(name)
    tags = [F.when(_holds(low, parts), F.lit(tag)) for tag, parts in NAME_TAGS]
    tags[4:4] = [F.when(kind == k, F.lit(k)) for k in ("interface", "class")]
    return F.array_compact(F.array(*tags))


def pattern_names(name: Column, kind: Column, layer_of: Column) -> Column:
    low = F.lower(name)
    tags = [F.when(F.contains(low, F.lit(part)), F.lit(tag)) for tag, part in PATTERN_NAMES]
    tags += [F.when(kind == "interface", F.lit("Interface Segregation")), F.when(layer_of == "domain", F.lit("Domain Model"))]
    return F.array_compact(F.array(*tags))


def architecture(layers: Column) -> Column:
    """The style that a set of layers stands for."""
    has = lambda *names: reduce(lambda a, b: a & b, [F.array_contains(layers, n) for n in names])
    return F.when(has("frontend", "api", "domain"), "Clean Architecture").when(has("controller", "service", "repository"), "MVC Pattern").when(has("api", "domain", "data"), "Layered Architecture").otherwise("Custom Architecture")


def entity_advice(layers: Column, n: Column, confidence: Column) -> Column:
    """Codes of what to do about an entity, given the layers in which it was found."""
    has = lambda name: F.array_contains(layers, name)
    return F.array_compact(F.array(
        F.when(n == 0, "create_dto"),
        F.when(~has("frontend") & has("api"), "add_frontend_type"),
        F.when(~has("database") & has("domain"), "add_database_schema"),
        F.when(confidence < 0.5, "review_naming"),
        F.when(F.size(layers) == 1, "single_layer"),
    ))


def search_content(*columns: Column) -> Column:
    """Non-empty values joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns])


def embedding_confidence(code: Column, *context: Column) -> Column:
    """0.5, and 0.1 each for over 100 and over 500 characters and for each piece of context that is there; 1 at most."""
    n = F.length(code)
    total = 0.5 + F.when(n > 100, 0.1).otherwise(0.0) + F.when(n > 500, 0.1).otherwise(0.0)
    for c in context:
        total = total + F.when(c.isNotNull(), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def enriched(path: Column, layer_of: Column, language: Column, code: Column, imports: Column | None = None, exports: Column | None = None, types: Column | None = None, patterns: Column | None = None) -> Column:
    """Source text under comment lines that name its file, layer and language, and what it imports, exports, declares and follows (arrays)."""
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"// {label}: "), c))
    listed = lambda label, c: [] if c is None else [F.when(F.size(c) > 0, F.concat(F.lit(f"// {label}: "), F.array_join(c, ", ")))]
    more = [x for label, c in (("Imports", imports), ("Exports", exports), ("Types", types), ("Patterns", patterns)) for x in listed(label, c)]
    return F.concat_ws("\n", line("File", path), line("Layer", layer_of), line("Language", language), *more, code)


def cache_key(model: Column, text: Column) -> Column:
    """What an embedding is stored under: the model and the digest of the whole text."""
    return F.sha2(F.concat_ws("\n", model, text), 256)


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves up; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole + 0.5)).cast("int")


def indentation(line: Column) -> Column:
    return F.regexp_extract(line, r"^([ \t]*)", 1)


def escaped_pattern(text: Column) -> Column:
    """A regular expression for the text itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def absolute_path(path: Column, root: str) -> Column:
    """``path`` below ``root``, unless it begins with a slash."""
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def explore_advice(n: Column, layers: Column, patterns: Column) -> Column:
    """Codes of what to do about a search's hits: how many there are, their layers and their patterns."""
    return F.array_compact(F.array(F.when(n == 0, "broaden_query"), F.when(F.size(layers) > 2, "cross_cutting"), F.when(F.size(patterns) == 0, "no_known_pattern")))


def extension(path: Column) -> Column:
    """The part from the last full stop of the last path element, or empty."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def usage_label(n: Column, heavy: int = 15, moderate: int = 5) -> Column:
    return F.when(n > heavy, "heavy").when(n > moderate, "moderate").otherwise("light")


def pattern_complexity(pattern: Column) -> Column:
    """Quantifiers, brackets, alternatives and properties count one each, lookarounds two."""
    count = lambda p: F.regexp_count(pattern, F.lit(p))
    return count(r"[*+?]") + count(r"[\[\](){}]") + 2 * count(r"\(\?<?[=!]") + count(r"\\p\{") + count(r"\|")


def glob_regex(glob: str) -> str:
    """An unanchored, case-ignoring regular expression for a path glob; ``**`` crosses directories."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + r"[^/\\]*", i + 1
        elif glob[i] == "?":
            out, i = out + r"[^/\\]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in r".+()[]{}^$|\\" else glob[i]), i + 1
    return "(?i)" + out


def expanded_queries(query: str, language: str | None = None, patterns: tuple[str, ...] = ()) -> list[str]:
    """The query and its variants for a language and patterns."""
    return [query, *([f"{language} code: {query}"] if language else []), *[f"{query} {p} pattern" for p in patterns]]


def folded(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts; ``..`` above the top stays away."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))
