"""What a source file's structure is read by: strings and comments told apart from code, and nested units of code.

``Lexicon`` names a language's comments, strings and kind of blocks. ``blank`` works through a text with a stack of states
(code, template literals and the code inside them, nested comments). ``units`` walks over the blanked text with a
stack of scopes: braces, indentation, or keywords that ``end`` closes. Both take time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_TRIPLES = r'"""(?:\\.|[^"\\]|"(?!""))*(?:"""|\Z)', r"'''(?:\\.|[^'\\]|'(?!''))*(?:'''|\Z)"
_CHARACTER = r"'(?:\\[^\n]{1,10}?|[^'\\\n])'"


@dataclass(frozen=True)
class Lexicon:
    """A language's lexical rules; ``blocks`` is brace, indent, end or statement."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested: bool = False
    strings: tuple[str, ...] = (_DOUBLE, _SINGLE)
    template: bool = False
    slashes: bool = False
    blocks: str = "brace"
    newline: bool = False
    labels: bool = False
    openers: str = ""
    closers: str = "end"


_C = Lexicon()
_ECMA = Lexicon(template=True, slashes=True, newline=True)
_HASH = {"line": ("#",), "block": ()}
_HEREDOC = r"<<[~-]?(?P<quote>['\"]?)(?P<{0}>[A-Za-z_]\w*)(?P=quote)[^\n]*\n(?:(?![ \t]*(?P={0})[ \t]*(?:\n|\Z))[^\n]*\n)*[ \t]*(?P={0})?"
# Lexical rules of the languages.
LEXICONS: dict[str, Lexicon] = {
    "javascript": _ECMA,
    "typescript": _ECMA,
    "qmljs": _ECMA,
    "java": Lexicon(strings=(_TRIPLES[0], _DOUBLE, _SINGLE)),
    "c": _C,
    "cpp": Lexicon(labels=True, strings=(r'R"(?P<raw>[^\s()\\"]{0,16})\((?:(?!\)(?P=raw)")(?s:.))*(?:\)(?P=raw)"|\Z)', _DOUBLE, r"(?<![0-9A-Fa-f])" + _SINGLE)),
    "c_sharp": Lexicon(strings=(_TRIPLES[0], r'(?:\$@|@\$|@)"(?:""|[^"])*(?:"|\Z)', _DOUBLE, _SINGLE)),
    "go": Lexicon(strings=(r"`[^`]*(?:`|\Z)", _DOUBLE, _SINGLE), newline=True),
    "rust": Lexicon(nested=True, strings=(r'b?r(?P<raw>#*)"(?:(?!"(?P=raw))(?s:.))*(?:"(?P=raw)|\Z)', r'"(?:\\(?s:.)|[^"\\])*(?:"|\Z)', _CHARACTER)),
    "swift": Lexicon(nested=True, strings=(_TRIPLES[0], _DOUBLE), newline=True),
    "kotlin": Lexicon(nested=True, strings=(_TRIPLES[0], _DOUBLE, _CHARACTER), newline=True),
    "dart": Lexicon(nested=True, strings=(*_TRIPLES, _DOUBLE, _SINGLE)),
    "php": Lexicon(line=("//", "#(?!\\[)"), strings=(r"<<<[ \t]*(?P<quote>['\"]?)(?P<doc>[A-Za-z_]\w*)(?P=quote)[^\n]*\n(?:(?![ \t]*(?P=doc)\b)[^\n]*\n)*[ \t]*(?:(?P=doc)|\Z)", r'"(?:\\(?s:.)|[^"\\])*(?:"|\Z)', r"'(?:\\(?s:.)|[^'\\])*(?:'|\Z)")),
    "zig": Lexicon(block=(), strings=(r"\\\\[^\n]*", _DOUBLE, _CHARACTER)),
    "css": Lexicon(line=(), strings=(_DOUBLE, _SINGLE)),
    "bash": Lexicon(line=("(?<![^\\s;(])#",), block=(), strings=(_HEREDOC.format("doc"), r"\$\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*\}", r"'[^']*(?:'|\Z)", r'"(?:\\(?s:.)|[^"\\])*(?:"|\Z)'), newline=True),
    "powershell": Lexicon(line=("#",), block=(("<#", "#>"),), strings=(r'@"[^\n]*\n(?:(?!"@)(?s:.))*(?:"@|\Z)', r"@'[^\n]*\n(?:(?!'@)(?s:.))*(?:'@|\Z)", r'"(?:`(?s:.)|""|[^"`])*(?:"|\Z)', r"'(?:''|[^'])*(?:'|\Z)"), newline=True),
    "python": Lexicon(**_HASH, strings=(*_TRIPLES, _DOUBLE, _SINGLE), blocks="indent"),
    "gdscript": Lexicon(**_HASH, strings=(*_TRIPLES, _DOUBLE, _SINGLE), blocks="indent"),
    "ruby": Lexicon(
        line=("#(?!\\{)",), block=(("\n=begin", "\n=end"),), blocks="end",
        strings=(_HEREDOC.format("doc").replace("<<[~-]?", "<<[~-]"), r'"(?:\\(?s:.)|#\{[^{}"]*(?:"[^"]*"[^{}"]*)*\}|[^"\\])*(?:"|\Z)', r"'(?:\\(?s:.)|[^'\\])*(?:'|\Z)", r"%[qQwWiI]?(?:\([^()]*\)|\{[^{}]*\}|\[[^\[\]]*\])"),
        openers=r"^(?:class|module|if|unless|case|while|until|for|begin)\b|^(?:(?:private|protected|public)\s+)?def\b(?!.*[\w)]\s=\s)|(?<==)\s*(?:if|unless|case|begin|while)\b|(?<![\w.:])do\b(?=\s*(?:\||$))",
    ),
    "lua": Lexicon(
        line=("--(?!\\[=*\\[)",), block=(("--[[", "]]"),), blocks="end", closers="end|until",
        strings=(r"\[(?P<long>=*)\[(?:(?!\](?P=long)\])(?s:.))*(?:\](?P=long)\]|\Z)", _DOUBLE, _SINGLE), openers=r"(?<![\w.:])(?:function|do|if|repeat)\b",
    ),
    "sql": Lexicon(line=("--",), strings=(r"\$(?P<tag>\w*)\$(?:(?!\$(?P=tag)\$)(?s:.))*(?:\$(?P=tag)\$|\Z)", r"'(?:''|[^'])*(?:'|\Z)"), blocks="statement"),
}


@lru_cache(128)
def _token(lexicon: Lexicon) -> re.Pattern[str]:
    """Comments, strings, and what changes the state of the lexer."""
    parts = []
    if lexicon.block and not lexicon.nested:
        parts += ["(?P<c{}>{}(?:(?!{})(?s:.))*(?:{}|\\Z))".format(i, re.escape(a).replace("\\\n", "(?:(?<=\n)|\\A)" if a[0] == "\n" else "\n"), re.escape(b).replace("\\\n", "\n"), re.escape(b).replace("\\\n", "\n") + ("[^\n]*" if b[0] == "\n" else "")) for i, (a, b) in enumerate(lexicon.block)]
    if lexicon.nested:
        parts.append(f"(?P<nest>{re.escape(lexicon.block[0][0])})")
    if lexicon.line:
        parts.append(f"(?P<cl>(?:{'|'.join(lexicon.line)})[^\n]*)")
    parts += [f"(?P<s{i}>{s})" for i, s in enumerate(lexicon.strings)]
    if lexicon.template:
        parts.append(r"(?P<tick>`)|(?P<open>\{)|(?P<close>\})")
    if lexicon.slashes:
        parts.append(r"(?P<sl>(?<![\w)\]'\"`/*}])(?<![\w)\]'\"`}][ \t])/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*)")
    return re.compile("|".join(parts))


@lru_cache(128)
def _first(lexicon: Lexicon) -> re.Pattern[str] | None:
    """What a comment or string of languages like C, Python and Ruby begins with: other text is passed over without trying each rule at each character.

    Outside of template literals braces change nothing.
    """
    if lexicon.blocks == "indent":
        return re.compile("[\"'#]")
    if lexicon == LEXICONS["ruby"]:
        return re.compile("\"|'|#|%|<<|=b")
    plain = lexicon.line == ("//",) and lexicon.block == (("/*", "*/"),) and set(lexicon.strings) <= {_DOUBLE, _SINGLE, _TRIPLES[0], _TRIPLES[1]}
    return re.compile("[\"'`/]") if plain else None


#: A line end in a string; white space for what reads units.
INNER = "\x1f"
_IN_TEMPLATE = re.compile(r"\\(?s:.)|`|\$\{")


def blank(text: str, lexicon: Lexicon) -> tuple[str, str, list[tuple[int, int]]]:
    """(``text`` without strings and comments, without comments, places of the comments); what goes becomes spaces, lines stay.

    A line end in a string becomes INNER in the first, as no statement ends there.
    """
    token, first, strings, comments, at = _token(lexicon), _first(lexicon), [], [], 0
    state: list[int] = []  # of template literals: -1 inside one, or the depth of braces in the code inside it
    while True:
        if state and state[-1] < 0:
            m = _IN_TEMPLATE.search(text, at)
            to = m.end() if m else len(text)
            strings.append((at, to))
            if m and m.group() == "`":
                state.pop()
            elif m and m.group() == "${":
                state.append(0)
            at = to
            if not m:
                break
            continue
        if first and not state:
            if not (begun := first.search(text, at)):
                break
            at = begun.start()
            if not (m := token.match(text, at)):
                at += 1
                continue
        elif not (m := token.search(text, at)):
            break
        name, at = m.lastgroup, m.end()  # of nested groups the outer one ends last
        if name == "tick":
            state.append(-1)
            strings.append((m.start(), at))
        elif name == "open":
            if state:
                state[-1] += 1
        elif name == "close":
            if state and state[-1] == 0:
                state.pop()
                strings.append((m.start(), at))
            elif state:
                state[-1] -= 1
        elif name == "nest":
            a, b = lexicon.block[0]
            deep, either = 1, re.compile(f"{re.escape(a)}|{re.escape(b)}")
            while deep and (n := either.search(text, at)):
                deep += 1 if n.group() == a else -1
                at = n.end()
            at = len(text) if deep else at
            comments.append((m.start(), at))
        elif name[0] == "c":
            comments.append((m.start(), at))
        else:
            strings.append((m.start(), at))
        if at == m.start():
            at += 1
    code = _without(text, comments)
    return _without(code, strings, INNER), code, comments


def _without(text: str, spans: list[tuple[int, int]], line: str = "\n") -> str:
    out, at = [], 0
    for a, b in spans:
        gone = text[a:b]
        out += [text[at:a], line.join([" " * len(x) for x in gone.split("\n")]) if "\n" in gone else " " * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def with_lines(bare: str, text: str) -> str:
    """``bare`` with the line ends of ``text`` that are inside strings."""
    return "".join(["\n" if c == INNER and t == "\n" else c for c, t in zip(bare, text, strict=True)]) if INNER in bare else bare


@dataclass(slots=True)
class Unit:
    """A statement, or a block with what stands before it: text[start:end], whose head ends at ``head``; ``parent`` is the unit around it, -1 for none."""

    start: int
    head: int
    end: int
    parent: int
    block: bool
    tail: tuple[int, int] | None = None  # what belongs to the head but stands after the block
    lead: str = ""  # the keyword of the list that the unit stands in


_GOES_ON = re.compile(r"[,(\[=+\-*/%&|^<>?:.\\]\s*$|\b(?:extends|implements|return)\s*$")
_COMES_ON = re.compile(r"\s*(?:[.{)?:&|+*/%=<>,\]]|(?:extends|implements|where|throws|permits|with|on)\b)")
#: Brackets without others inside are passed over in one go; line ends behind what ends or opens a statement, or another line end, mean nothing.
_BRACE = re.compile(r"\([^(){}\[\]]*\)|[{}()\[\];]|(?<![;{\n])\n")
#: Where no line end means anything.
_FREE_BRACE = re.compile(r"\([^(){}\[\]]*\)|[{}()\[\];]")
_NAMES = re.compile(r"\s*(?:(?:import|export)(?:\s+type)?|import\s+\w+\s*,|const|let|var|use\s+[\w:]+::)\s*$")
_LABEL = re.compile(r"(public|private|protected)(?:\s+\w+)?\s*:(?!:)\s*")
_LIST = re.compile(r"\s*(import|const|var|type)\s*$")
_INSIDE = re.compile(r"[^(){}\[\]]*\}")
_SCOPES = ("{", "list")


class Lines(dict):
    """What logical lines come to, which are often alike; only so many and only short ones are remembered."""

    MOST, LONGEST = 50_000, 400

    def put(self, key: str | tuple[str, str], size: int, value: tuple) -> tuple:
        if size <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[key] = value
        return value


def units(bare: str, code: str, lexicon: Lexicon, wanted: Callable[[str, str, bool], bool] | None = None, lines: Lines | None = None) -> list[Unit]:
    """Units in the order of their starts, those of a block after it; ``bare`` and ``code`` come from ``blank``.

    Statements that aren't ``wanted`` (by their text, the keyword of their list, and whether they stand in a unit) are left
    out; blocks never are. ``lines`` may be kept for other texts of the language that are asked the same.
    """
    lines = Lines() if lines is None else lines
    return {"brace": _braces, "indent": _indents, "end": _ends, "statement": _statements}[lexicon.blocks](bare, code, lexicon, wanted, lines)


def _braces(bare: str, code: str, lexicon: Lexicon, wanted: Callable[[str, str, bool], bool] | None, lines: Lines) -> list[Unit]:
    out: list[Unit] = []
    stack: list[tuple[str, int, int]] = []  # bracket, unit around it, where the statement around it began
    begin, owner, lead, typedef = 0, -1, "", -1

    def put(to: int, head: int, block: bool) -> int:
        body = code[begin:head].lstrip()
        start = head - len(body) if head > begin else begin
        if lexicon.labels and (label := _LABEL.match(code, start, head)):  # a unit of its own, without an end
            out.append(Unit(start, label.end(1), label.end(1), owner, False))
            start = label.end()
        if start >= head and not block:
            return -1
        if to == head and not block:
            to = head = head - len(body) + len(body.rstrip())
        if wanted and not block and not wanted(code[start:head], lead, owner >= 0):
            return -1
        out.append(Unit(min(start, head), head, to, owner, block, lead=lead))
        return len(out) - 1

    search, past = (_BRACE if lexicon.newline or "#" in code else _FREE_BRACE).search, 0
    while m := search(bare, past):
        c, (at, past) = m.group(), m.span()
        outside = not stack or stack[-1][0] in _SCOPES
        if len(c) > 1:
            if not (outside and lexicon.newline and _LIST.match(bare, begin, at)):
                continue
            c, past = "(", at + 1
        if c == "(" and outside and lexicon.newline and (listed := _LIST.match(bare, begin, at)):
            unit = put(len(bare), at, True)
            stack.append(("list", owner, at + 1))
            begin, owner, lead = at + 1, unit, listed.group(1) + " "
        elif c in "([":
            stack.append((c, owner, begin))
        elif c == "{" and _NAMES.match(bare, begin, at):
            if closed := _INSIDE.match(bare, past):
                past = closed.end()
            else:
                stack.append(("names", owner, begin))
        elif c == "{":
            begun = at + 1
            if not outside:  # a function or an object among arguments: its head is what is before it there
                inside = bare[begin:at]
                begun, begin = begin, at - len(inside) + max(inside.rfind(","), inside.rfind("("), inside.rfind("[")) + 1
            unit = put(len(bare), at, True)
            stack.append((c, owner, begun))
            begin, owner = at + 1, unit
        elif c == ")" and stack and stack[-1][0] == "list":
            put(at, at, False)
            out[owner].end, owner, begin, lead = at + 1, stack.pop()[1], at + 1, ""
        elif c in ")]":
            if stack and stack[-1][0] == {")": "(", "]": "["}[c]:
                stack.pop()
        elif c == "}":
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in ("{", "names"):
                k -= 1
            if k < 0:
                begin = at + 1
            elif stack[k][0] == "names":
                del stack[k:]
            else:
                put(at, at, False)
                out[owner].end = at + 1
                typedef = owner if code.startswith("typedef", out[owner].start) else -1
                _, owner, begun = stack[k]
                del stack[k:]
                begin = begun if stack and stack[-1][0] not in _SCOPES else at + 1
        elif outside and c == ";":
            if typedef >= 0 and typedef < len(out) and bare[begin:at].strip():
                out[typedef].tail, out[typedef].end = (begin, at), at + 1
            else:
                put(at + 1, at, False)
            begin, typedef = at + 1, -1
        elif outside and c == "\n":
            line = code[begin:at].strip()
            directive = line.startswith("#") and not line.startswith("#[") and not lexicon.newline
            if not line and lexicon.newline:
                begin = at + 1
            elif directive or lexicon.newline and not _GOES_ON.search(code, begin, at) and not _COMES_ON.match(bare, at + 1):
                put(at, at, False)
                begin = at + 1
    put(len(bare), len(bare), False)
    return out


_ANY_BRACKET = re.compile(r"[()\[\]{}]")
_INDENTED = re.compile(r"(?:async\s+)?(?:class|def|func|static\s+func)\b")


def _logical(bare: str, code: str, known: Lines, told: Callable[[str, str], tuple]) -> Iterator[tuple[int, tuple]]:
    """(where it begins, what is ``told`` of its code and bare text) of each logical line: brackets and a backslash at the end join lines."""
    plain = bare.split("\n")
    if INNER in bare:  # there the code has line ends
        ends = list(accumulate([len(x) + 1 for x in plain]))
        pairs = zip([code[e - len(x) - 1 : e - 1] for x, e in zip(plain, ends, strict=True)], plain, strict=True)
    else:
        pairs = zip(code.split("\n"), plain, strict=True)
    begin, deep, at, last = 0, 0, 0, len(plain)
    for key in pairs:
        if (line := known.get(key)) is None:
            text = key[1]
            more = sum(map(text.count, "([{")) - sum(map(text.count, ")]}")) if _ANY_BRACKET.search(text) else 0
            line = known.put(key, len(text), (more, text[-1:] != "\\", told(*key)))
        to = at + len(key[1])
        deep += line[0]
        last -= 1
        if deep <= 0 and line[1] or not last:
            yield begin, line[2] if begin == at else told(code[begin:to], bare[begin:to])
            begin, deep = to + 1, 0
        at = to + 1


def _indented(line: str, bare: str) -> tuple:
    """Of a logical line: (length without what is blank at its end, or None, where it begins, indentation, whether it is a block's head, its code or None)."""
    body = bare.strip()
    if not body:
        return len(line.rstrip()) if line.strip() else None, 0, 0, False, None
    lead, size = len(line) - len(line.lstrip()), len(line.rstrip())
    indent = len(line[:lead].expandtabs(8)) if "\t" in line[:lead] else lead
    return size, lead, indent, body.endswith(":") or _INDENTED.match(body) is not None, line[lead:size]


def _indents(bare: str, code: str, lexicon: Lexicon, wanted: Callable[[str, str, bool], bool] | None, lines: Lines) -> list[Unit]:
    out: list[Unit] = []
    stack: list[tuple[int, int]] = []  # indentation, unit
    last = 0
    for a, (size, lead, indent, block, text) in _logical(bare, code, lines, _indented):
        if text is None:
            last = last if size is None else a + size
            continue
        while stack and indent <= stack[-1][0]:
            out[stack.pop()[1]].end = last
        last = a + size
        if block or not wanted or wanted(text, "", bool(stack)):
            out.append(Unit(a + lead, last, last, stack[-1][1] if stack else -1, block))
        if block:
            stack.append((indent, len(out) - 1))
    while stack:
        out[stack.pop()[1]].end = last
    return out


@lru_cache(64)
def _end_words(opening: str, closing: str) -> tuple[re.Pattern[str], re.Pattern[str]]:
    return re.compile(opening), re.compile(rf"(?<![\w.:@])(?:{closing})\b(?!\s*[=:](?!=))")


_LOOP, _DO, _PART = re.compile(r"(?:while|until|for)\b"), re.compile(r"\bdo$"), re.compile(r"[^;]+")


@lru_cache(65536)
def _opened(opening: str, closing: str, body: str) -> tuple[int, int]:
    """How many blocks a statement opens and closes; statements are often alike."""
    openers, closers = _end_words(opening, closing)
    more, fewer = len(openers.findall(body)), len(closers.findall(body))
    if closing == "end" and _LOOP.match(body) and _DO.search(body):
        more -= 1
    return more, fewer


def _ends(bare: str, code: str, lexicon: Lexicon, wanted: Callable[[str, str, bool], bool] | None, lines: Lines) -> list[Unit]:
    out: list[Unit] = []
    stack: list[int] = []
    words = lexicon.openers, lexicon.closers
    for a, parts in _logical(bare, code, lines, lambda code, bare: tuple(_parts(code, bare, words))):
        for start, past, more, fewer, text in parts:
            if more == fewer or not fewer or more > fewer:
                owner = stack[-1] if stack else -1
                if owner < 0 and stack:
                    owner = next((u for u in reversed(stack) if u >= 0), -1)
                block = more > fewer
                if block or not wanted or wanted(text, "", owner >= 0):
                    out.append(Unit(a + start, a + past, len(bare) if block else a + past, owner, block))
                if block:
                    stack += [len(out) - 1] + [-1] * (more - fewer - 1)
            for _ in range(fewer - more):
                if stack and (u := stack.pop()) >= 0:
                    out[u].end = a + past
    return out


def _parts(code: str, bare: str, words: tuple[str, str]) -> Iterator[tuple[int, int, int, int, str]]:
    """(start, end, blocks opened, closed, code) of each statement of a logical line."""
    for m in _PART.finditer(bare):
        part, at = m.group(), m.start()
        if body := part.strip():
            start, past = at + len(part) - len(part.lstrip()), at + len(code[at : m.end()].rstrip())
            yield start, past, *_opened(*words, body), code[start:past]


def _statements(bare: str, code: str, lexicon: Lexicon, wanted: Callable[[str, str, bool], bool] | None, lines: Lines) -> list[Unit]:
    """Statements that ; ends; the parts between commas of their first brackets, or of a leading WITH, are units inside."""
    out: list[Unit] = []
    begin, deep, inner, owner = 0, 0, 0, -1
    with_list = False

    def put(a: int, b: int, parent: int) -> int:
        body = code[a:b]
        if not body.strip():
            return -1
        start = a + len(body) - len(body.lstrip())
        out.append(Unit(start, a + len(body.rstrip()), a + len(body.rstrip()), parent, False))
        return len(out) - 1

    for m in re.finditer(r"[();,]", bare):
        c, at = m.group(), m.start()
        if c == "(":
            deep += 1
            if deep == 1:
                if owner < 0:
                    owner = put(begin, at, -1)
                    with_list = owner >= 0 and bare[out[owner].start : at].lower().startswith("with")
                inner = at + 1
        elif c == ")":
            if deep == 1 and not with_list and owner >= 0:
                put(inner, at, owner)
                inner = at + 1
            deep = max(0, deep - 1)
        elif c == "," and deep == 1 and not with_list and owner >= 0:
            put(inner, at, owner)
            inner = at + 1
        elif c == "," and deep == 0 and with_list:
            nxt = bare.find("(", at)
            put(at, nxt if nxt > 0 else len(bare), owner)
        elif c == ";" and deep == 0:
            if owner < 0:
                put(begin, at, -1)
            else:
                out[owner].end = at + 1
            begin, owner, with_list = at + 1, -1, False
    if owner < 0:
        put(begin, len(bare), -1)
    else:
        out[owner].end = len(bare.rstrip())
    return out
