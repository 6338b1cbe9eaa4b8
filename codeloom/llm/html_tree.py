"""Pages as trees of elements with text segments, and the features of each element.

Block elements are nodes, and so are inline elements with a class, id or role. Every operation on the stack of open
elements looks up the last open element of a name, so that a page is read in time proportional to its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

# Element names of HTML by what becomes of them.
RAW = frozenset("script style noscript textarea iframe title".split())
HIDDEN = frozenset("template svg math object select datalist optgroup option button".split())
FOREIGN = frozenset(["svg", "math"])
# Elements in which svg and math hold elements of HTML, and inline ones that end an svg or math left open.
HOSTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
OUT = frozenset("b big br code em embed hr i img meta nobr ruby s small span strike strong sub sup tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset legend blockquote pre figure figcaption address details summary hgroup center dialog menu label".split()
)
BREAKS = frozenset(["br", "hr"])
# Which open elements an element of this name closes, and where the search for them ends.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ("html",)),
}
ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "label", "legend"}
# Words of notices, adverts and page ends, by the part that they show.
CUES = {
    "rights": ("©", "&copy;", "copyright", "all rights reserved", "imprint", "impressum", "terms of"),
    "notice": ("cookie", "privacy policy", "consent", "subscribe", "newsletter", "sign up", "log in", "sign in"),
    "advert": ("advert", "sponsored", "promoted", "buy now"),
    "link": ("read more", "read next", "related", "share", "follow us", "back to top", "skip to", "click here"),
    "comment": ("comment", "reply", "replies", "said:"),
}
#: Texts of elements up to this length are searched for cues: parts of pages that cues show are short.
CUE_CHARS = 400
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_CLASS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAMES = re.compile(r"[a-z]+")
_ENDS = {n: re.compile(rf"</{n}\s*+[^>]*+>|\Z", re.I) for n in RAW}
_CUE = re.compile("|".join(f"(?P<{k}>{'|'.join(map(re.escape, v))})" for k, v in CUES.items()))
_SIZES = (1, 10, 25, 50, 100, 200, 400, 800)


class Tree:
    """Nodes in page order: parent, tag, class words; segments, each a run of (node, text) pieces without a block's edge between them."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.words = [-1], ["#root"], [frozenset()]
        self.segments: list[list[tuple[int, str]]] = []
        self.attributes, self.text, self.linked, self.marks, self.cues = [""], [0], [0], [0], [set()]
        self._parse(page)

    def _parse(self, page: str) -> None:
        at, n = 0, len(page)
        run: list[tuple[int, str]] = []
        # the open elements: name ("" once closed out of turn), node; places of each name, and of blocks
        names, nodes, where, blocks = ["#root"], [0], {}, [0]
        # names of the open elements from the outermost HIDDEN one on: no nodes, and their text is never content
        hidden: list[str] = []
        inside: dict[str, int] = {}

        def close() -> None:
            if run:
                self.segments.append(list(run))
                run.clear()

        def text(piece: str) -> None:
            if piece and not hidden:
                node = nodes[-1]
                run.append((node, piece))
                size = len(piece.strip())
                if size:
                    self.text[node] += size
                    self.marks[node] += piece.count(".") + piece.count(",") + piece.count("。") + piece.count("?") + piece.count("!")
                    if where.get("a"):
                        self.linked[node] += size
                    if size <= CUE_CHARS:
                        self.cues[node].update(m.lastgroup for m in _CUE.finditer(piece.lower()))

        def last(of: tuple[str, ...]) -> int:
            return max((where[x][-1] for x in of if where.get(x)), default=0)

        def pop_to(depth: int) -> None:
            while len(names) > depth:
                if name := names.pop():
                    where[name].pop()
                nodes.pop()
            while blocks[-1] >= depth:
                blocks.pop()

        def push(name: str, attributes: str, block: bool) -> None:
            found = _CLASS.findall(attributes) if "=" in attributes else []
            if block or found:
                self.parent.append(nodes[-1])
                self.tag.append(name)
                self.words.append(frozenset(_NAMES.findall(" ".join(x for g in found for x in g).lower())))
                self.attributes.append(attributes), self.text.append(0), self.linked.append(0), self.marks.append(0), self.cues.append(set())
            nodes.append(len(self.tag) - 1 if block or found else nodes[-1])
            if block:
                blocks.append(len(names))
            where.setdefault(name, []).append(len(names))
            names.append(name)

        def hide(name: str) -> None:
            hidden.append(name)
            inside[name] = inside.get(name, 0) + 1

        def show() -> str:
            name = hidden.pop()
            inside[name] -= 1
            return name

        while at < n:
            m = TOKEN.search(page, at)
            if not m:
                text(page[at:])
                break
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name, ending, attributes = name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
            bare = attributes.endswith("/") and not attributes.endswith("=/")
            if name in RAW:
                if not ending and not (bare and hidden and hidden[-1] in FOREIGN):
                    at = _ENDS[name].search(page, at).end()
                continue
            if hidden:
                if not ending and (name in BLOCK or name in OUT):
                    while hidden and hidden[-1] in FOREIGN:
                        show()
                elif ending and not inside.get(name) and name in BLOCK and where.get(name):
                    while hidden:  # they close with their parent
                        show()
            if hidden or name in HIDDEN:
                if ending:
                    if inside.get(name):
                        while show() != name:
                            pass
                elif name in HIDDEN or name in BLOCK or (name in HOSTS and not bare):
                    if not (bare and name in ("svg", "math", "object")):
                        hide(name)
                continue
            if name in BREAKS:
                close()
            elif name in BLOCK:
                close()
                if ending:
                    if where.get(name):
                        pop_to(where[name][-1])
                    continue
                if name in ENDS_P and names[blocks[-1]] == "p":
                    pop_to(blocks[-1])
                if name in CLOSES:
                    shut, until = CLOSES[name]
                    while (d := last(shut)) > last(until):
                        pop_to(d)
                push(name, attributes, True)
            elif name not in VOID:
                d = where[name][-1] if where.get(name) else 0
                if d > blocks[-1] and (ending or name == "a"):
                    pop_to(d)
                elif d and name == "a":  # links end, whatever stands between
                    names[where[name].pop()] = ""
                if not ending and not bare:
                    push(name, attributes, False)
        close()

    def features(self) -> list[list[str]]:
        """Names of each node's features."""
        n = len(self.tag)
        inside, linked, below = list(self.text), list(self.linked), [0] * n
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            inside[up] += inside[i]
            linked[up] += linked[i]
            below[up] = max(below[up], below[i], self.text[i])
        whole, largest = max(1, inside[0]), max(1, max(self.text))
        # the article or main element with the most text, and what share of the page's text it has
        best = max((i for i in range(n) if self.tag[i] in ("article", "main")), key=inside.__getitem__, default=None)
        share = 0 if best is None else bisect_right((0.3, 0.6), inside[best] / whole)
        many = bisect_right((1, 3, 8), sum(t > 0 for t in self.text))
        out, within, seen = [], [False] * n, 0
        for i, tag in enumerate(self.tag):
            own, total = self.text[i], inside[i]
            within[i] = i == best or (i > 0 and within[self.parent[i]])
            dense = int(linked[i] / total * 4 + 0.5) if total else 0
            where, size = "unmarked" if best is None else f"{'in' if within[i] else 'out'} {share}", bisect_right(_SIZES, own)
            if own:
                part = bisect_right((0.02, 0.05, 0.1, 0.2, 0.4, 0.8), own / largest)
                row = [f"text {tag}", f"size {size}", f"links {dense} {size // 2}", f"linked {tag} {dense}", f"scope {where}", f"part {part} {many}"]
                row.append(f"marks {bisect_right((0, 1, 3, 6), self.marks[i])}")
                row.append(f"place {bisect_right((0.02, 0.1, 0.5, 0.9, 0.98), seen / whole)} {many}")
                row.append(f"{tag} in {self.tag[self.parent[i]]}")
                row.append(f"told {tag} {bool(self.words[i])} {bool(self.cues[i])}")
            else:
                row = [f"frame {tag}", f"frame links {dense}", f"frame scope {where}", f"inside {bisect_right((0.02, 0.1, 0.3, 0.6, 0.9), total / whole)} {min(1, many)}"]
                row.append(f"below {bisect_right(_SIZES, below[i])} {min(2, dense)}")
            row += ["class " + w for w in self.words[i]]
            row += [f"cue {c} {'long' if own > 100 else 'short'}" for c in self.cues[i]]
            seen += own
            out.append(row)
        return out

    def blocks(self, keep: list[bool]) -> list[str]:
        """Texts of the segments, of kept nodes only: references decoded, white space folded."""
        out = []
        for pieces in self.segments:
            if t := " ".join(html.unescape("".join(p for node, p in pieces if keep[node])).split()):
                out.append(t)
        return out
