"""Generated pages with known main text: the labelled pages that the extraction model is trained on."""

from __future__ import annotations

import random

from codeloom.llm.html_tree import Tree

# Class names of the parts of pages.
NAMES = {
    "nav": "nav menu navigation navbar main-menu breadcrumb topnav links".split(),
    "top": "header site-header masthead banner topbar page-header".split(),
    "foot": "footer site-footer copyright bottom colophon page-footer".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adbox ad-slot".split(),
    "notice": "notice cookie cookie-notice consent gdpr popup alert newsletter subscribe modal cookie-banner".split(),
    "side": "sidebar side related widget recommended popular tags more".split(),
    "comments": "comments discussion responses comment-list replies disqus".split(),
    "comment": "comment reply comment-body user-comment".split(),
    "share": "share social share-buttons follow".split(),
    "content": "content article post entry story article-body post-content main-content text entry-content".split(),
    "frame": "wrapper container page layout row site inner col".split(),
    "plain": "lead highlight intro note author date byline term x1 c4 quote-body".split(),
}
# What notices, adverts, page ends and the like say.
SAYINGS = {
    "foot": ("© 2021 {}", "&copy; {} &middot; {}", "Copyright {}. All rights reserved.", "Imprint {}", "Terms of use {}", "{}"),
    "notice": ("We use cookies {}", "This site uses cookies. {}", "By using this page you consent {}", "Privacy policy {}", "Subscribe to our newsletter {}", "Sign up {}", "{}", "{} {}"),
    "ad": ("Advertisement {}", "Sponsored: {}", "Buy now {}", "{}", "{} {}", "{}"),
    "share": ("Share {}", "Follow us {}", "{}"),
    "side": ("Related {}", "Read next: {}", "{}", "{}"),
}
_LETTERS = ("etaoinshrdlu", "enisratdhulüä", "esaitnrulodéè", "eaosrnidlctñó")


class _Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.letters, self.marked = self.r.choice(_LETTERS), False

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(self.letters, k=r.randint(1, 10))) for _ in range(r.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        """Sentences of ``low`` to ``high`` words in all, with a comma here and there."""
        left, out = self.r.randint(low, high), []
        while left > 0:
            n = min(left, self.r.randint(3, 18))
            s = self.words(n, n).capitalize()
            out.append((s.replace(" ", ", ", 1) if self.chance(0.3) else s) + self.r.choices(".?!", (8, 1, 1))[0])
            left -= n
        return " ".join(out)

    def say(self, kind: str, low: int, high: int) -> str:
        text = self.r.choice(SAYINGS[kind])
        return text.format(*[self.prose(low, high) for _ in range(text.count("{}"))])

    def wrap(self, kind: str, tags: list[str], inner: str, mark: str = "") -> str:
        """``inner`` in one of ``tags``, with a class or id of its kind or, for tags that tell, perhaps without."""
        tag = self.r.choice(tags)
        named = tag in ("div", "section", "ul", "ol", "li", "p", "table", "span", "article") or self.chance(0.4)
        attribute = f' {self.r.choices(("class", "id"), (5, 1))[0]}="{self.r.choice(NAMES[kind])}{" " + self.r.choice(NAMES["plain"]) if self.chance(0.15) else ""}"' if named else ""
        return f"<{tag}{attribute}{mark}>{inner}</{tag}>"

    def links(self) -> str:
        r = self.r
        item = lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, r.choice((2, 4, 8)))}</a>'
        n = r.randint(2, 9)
        if self.chance(0.6):
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return r.choice((" | ", " ", "<br>")).join(item() for _ in range(n))

    # what isn't main text

    def nav(self) -> str:
        if self.chance(0.35):
            return f"<div>{self.links()}</div>" if self.chance(0.8) else f"<p>{self.links()}</p>"
        return self.wrap("nav", ["nav", "nav", "div", "ul"], self.links())

    def top(self) -> str:
        inner = f"<h1>{self.words(1, 4)}</h1><p>{self.words(2, 8)}</p>" if self.chance(0.4) else f"<p>{self.words(2, 8)}</p>{self.nav()}" if self.chance(0.6) else self.words(1, 6)
        return self.wrap("top", ["header", "header", "div"], inner)

    def foot(self) -> str:
        inner = self.say("foot", 1, 18)
        if self.chance(0.3):
            return f"<{(t := self.r.choice(['div', 'p', 'center', 'address']))}>{self.r.choice(SAYINGS['foot'][:5]).format(self.words(1, 6), self.words(1, 4))}</{t}>"
        return self.wrap("foot", ["footer", "footer", "div"], f"<p>{inner}</p>" if self.chance(0.4) else inner)

    def ad(self) -> str:
        inner = self.say("ad", 2, 25)
        if self.chance(0.15):
            return f"<div>{self.r.choice(SAYINGS['ad'][:3]).format(self.prose(1, 12))}</div>"
        return self.wrap("ad", ["div", "div", "aside", "section"], inner if self.chance(0.6) else f"<p>{inner}</p>")

    def notice(self) -> str:
        if self.chance(0.3):
            text = self.r.choice(SAYINGS["notice"][:6]).format(self.prose(1, 14))
            return self.r.choice(("<div>{}</div>", "<p>{}</p>", "<div><p>{}</p></div>", "<section>{}</section>")).format(text)
        inner = self.say("notice", 3, 20)
        return self.wrap("notice", ["div", "section", "aside"], inner if self.chance(0.4) else f"<p>{inner}</p>")

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" * self.chance(0.7) + (self.links() if self.chance(0.6) else f"<p>{self.say('side', 4, 40)}</p>")
        return f"<aside>{inner}</aside>" if self.chance(0.3) else self.wrap("side", ["aside", "div", "section"], inner)

    def form(self) -> str:
        return f"<form><label>{self.words(1, 3)}</label><input><p>{self.words(2, 9)}</p></form>"

    def share(self) -> str:
        links = " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(self.r.randint(1, 4)))
        return self.wrap("share", ["div", "ul", "p"], links if self.chance(0.7) else self.say("share", 1, 6))

    def comments(self) -> str:
        one = lambda: self.wrap("comment", ["div", "li", "article", "p"], f"<p>{self.prose(3, 60)}</p>" if self.chance(0.7) else self.prose(3, 40))
        inner = f"<h2>{self.words(1, 2)} comments</h2>" * self.chance(0.6) + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.wrap("comments", ["section", "div", "ol"], inner)

    # main text: elements with the attribute data-y

    def running(self, low: int, high: int, shares: tuple[float, ...] = (0.1, 0.3, 0.6, 1.0)) -> str:
        """Prose, perhaps with links, marked words and references to characters."""
        text = self.prose(low, high)
        if self.chance(0.08):  # lists, and text without sentences
            text = self.r.choice((" ", " | ", " ")).join(self.words(1, 2) for _ in range(self.r.randint(low, high)))
        elif self.chance(0.25):
            share = self.r.choice(shares)
            text = " ".join(f'<a href="#">{s}</a>' if self.chance(share) else s for s in text.split(". "))
            if share == 1.0:
                text = f'<a href="/x">{self.prose(low, high)}</a>'
        if self.chance(0.1):
            text += f' <span class="{self.r.choice(NAMES["plain"])}" data-y>{self.words(1, 3)}</span> {self.words(1, 3)}'
        if self.chance(0.05):
            text += f' <span class="{self.r.choice(NAMES["ad"])}">{self.say("ad", 1, 8)}</span>'
        if self.chance(0.04):
            text += self.r.choice((" cookie", " comment", " copyright", " share", " related")) + " " + self.words(2, 9)
        if self.marked and self.chance(0.08):  # where the page says what its article is, words of other parts say little
            text = self.sayings() + self.chance(0.5) * (" " + text)
        return f"<b>{text}" if self.chance(0.05) else f"<em>{text}</em>" if self.chance(0.05) else text

    def sayings(self) -> str:
        return " ".join(self.say(self.r.choice(list(SAYINGS)), 0, 3).strip() for _ in range(self.r.randint(1, 4)))

    def part(self) -> str:
        r, x = self.r, self.r.random()
        if x < 0.72:
            return f"<p data-y>{self.running(*r.choice([(1, 3), (1, 10), (4, 40), (20, 120)]))}" + "</p>" * (not self.chance(0.1))
        if x < 0.78:
            return f"<h{(k := r.randint(2, 4))} data-y>{self.words(1, 8)}</h{k}>"
        if x < 0.83:
            return "<ul data-y>" + "".join(f"<li data-y>{self.running(1, 20, (0.1, 0.3))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if x < 0.86:
            return f"<blockquote data-y><p data-y>{self.running(4, 40)}</p></blockquote>"
        if x < 0.88:
            return f"<figure data-y><img><figcaption data-y>{self.words(2, 12)}</figcaption></figure>"
        if x < 0.9:
            return f"<pre data-y>{self.words(3, 20)}</pre>"
        if x < 0.92:
            return "<table data-y>" + "".join(f"<tr data-y><td data-y>{self.words(1, 5)}</td><td data-y>{self.words(1, 5)}</td></tr>" for _ in range(3)) + "</table>"
        if x < 0.95:
            return f"<div data-y>{self.running(4, 60)}</div>"
        return r.choice([self.ad, self.share, self.form, self.notice, self.side])()

    def body(self) -> str:
        title = ""
        if self.chance(0.75):
            title = f"<h1 data-y>{self.sayings() if self.marked and self.chance(0.1) else self.words(2, 9)}</h1>"
            if self.chance(0.1):
                title = f"<header data-y>{title}</header>"
        n = self.r.randint(1, self.r.choice((2, 4, 12, 12, 12, 12, 60)))
        if self.chance(0.25):  # text without paragraphs of its own
            return title + self.r.choice(("<br>", "<br><br>", " ")).join(self.running(*self.r.choice([(2, 9), (10, 40), (10, 90)])) for _ in range(min(n, 6)))
        inner = "".join(self.part() for _ in range(n))
        return title + inner + self.r.choice((self.foot, self.share, self.notice))() * self.chance(0.15)

    def wrapped(self) -> tuple[str, bool]:
        """The main part, and whether its text or paragraphs stand in no element of their own."""
        kind = self.r.random()
        self.marked = kind < 0.42
        inner = self.body()
        if kind < 0.3:
            return f"<article{self.r.choice(('', '', ' class=post'))} data-y>{inner}</article>", False
        if kind < 0.42:
            return f"<main data-y>{inner}</main>", False
        if kind < 0.58:
            return self.wrap("content", ["div", "section"], inner, " data-y"), False
        if kind < 0.65:
            return f"<table><tr><td>{self.links()}</td><td data-y>{inner}</td></tr></table>", False
        deep = self.r.choice((0, 0, 1, 1, 1, 2, 3))
        return "<div>" * max(0, deep - 1) + "<div data-y>" * min(1, deep) + inner + "</div>" * deep, not deep

    def page(self) -> tuple[str, bool]:
        often = self.r.choice((0.0, 0.2, 0.2, 1.0, 1.0, 1.0))  # pages without any other parts, with few, with many
        before = "".join(f() for f in (self.top, self.nav, self.notice, self.ad, self.side, self.form) if self.chance(0.35 * often))
        after = "".join(f() for f in (self.comments, self.share, self.side, self.ad, self.notice, self.form, self.nav) if self.chance(0.25 * often))
        middle, bare = self.wrapped()
        mark, inner = " data-y" if bare else "", before + middle + after
        if self.chance(0.3 * often):
            inner, mark = f'<div class="{self.r.choice(NAMES["frame"])}"{mark}>{inner}</div>', ""
        inner += self.foot() * self.chance(0.7 * often)
        shape = self.r.random()
        if shape < 0.1:
            return inner, bool(mark)
        if shape < 0.25:
            return f"<body{mark}>{inner}</body>", False
        return f"<html><head><title>{self.words(2, 5)}</title></head><body{mark}>{inner}</body></html>", False


def labelled_page(seed: int) -> tuple[str, bool]:
    """A page whose elements of main text carry the attribute data-y, and whether text outside of all elements is main text, too."""
    return _Page(seed).page()


def labels(tree: Tree, outside: bool) -> list[bool]:
    """Whether each node with text of its own is main text, and whether at least half the text inside the others is."""
    own = [outside, *("data-y" in a for a in tree.attributes[1:])]
    total, main = list(tree.text), [t * y for t, y in zip(tree.text, own, strict=True)]
    for i in range(len(own) - 1, 0, -1):
        total[tree.parent[i]] += total[i]
        main[tree.parent[i]] += main[i]
    return [y if t else 2 * m >= max(1, n) for y, t, m, n in zip(own, tree.text, main, total, strict=True)]
