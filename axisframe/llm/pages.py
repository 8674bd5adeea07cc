"""Labelled training pages: web pages of many layouts, whose every block is known to be article text or not.

No labelled pages come with the tables, so the training set is made here from a seed: layouts, tag names and class
names as they are common on the web, filled with random words of made-up languages. Nothing of it is taken from
the pages to be read.
"""

from __future__ import annotations

import random
from html import escape

# Names that web pages give to their parts.
MAIN = ["content", "main-content", "article", "post", "entry-content", "post-body", "story", "article-body", "text", "page-content", "blog-post"]
ASIDE = {
    "menu": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc"],
    "header": ["header", "masthead", "site-header", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal", "credits"],
    "sidebar": ["sidebar", "aside", "widget", "related", "related-posts", "tags", "share", "social", "archive", "popular", "trending"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "alert", "banner", "notice", "popup", "modal", "gdpr", "newsletter", "subscribe"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adbox"],
    "comments": ["comments", "comment", "comment-list", "respond", "discussion", "replies", "reader-comments"],
    "form": ["search-form", "login", "signup", "contact-form"],
}
TAGS = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "aside"], "advert": ["div", "aside", "ins"], "comments": ["section", "div", "ol"], "form": ["form", "div"]}


#: Marks in front of a block's text.
ARTICLE, OTHER = "\ue000", "\ue001"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = ["".join(self.r.choice(c) for c in ("bcdfghlmnprstvz", "aeiouäéíöü", ["", "n", "r", "s", "l", "t"])) for _ in range(70)]
        self.words = ["".join(self.r.choices(parts, k=self.r.choice([1, 1, 2, 2, 3]))) for _ in range(400)]
        self.mute = self.r.random() < 0.3  # no name on this page says anything
        self.claimed = False  # whether a tag or a name says where the article is

    def text(self, low: int, high: int) -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            w = r.choice(self.words)
            out.append(w.capitalize() if not out or out[-1].endswith(".") else w)
            if r.random() < 0.12:
                out[-1] += r.choice([".", ".", ",", "!", "?"])
        if r.random() < 0.15:
            junk = r.choice(["&&&", "###", "$$$", "|", "!!"])
            out = [w + (junk if junk != "|" else " |") if r.random() < 0.7 else w for w in out]
        return " ".join(out) + ("." if high > 12 and r.random() < 0.7 else "")

    def block(self, tag: str, text: str, main: bool, attrs: str = "", close: bool = True) -> str:
        """One block with its mark; marks are private-use characters that the reader of training pages takes away."""
        mark = ARTICLE if main else OTHER
        body = escape(text, quote=False)
        if self.r.random() < 0.15 and " " in body:
            a, b = body.split(" ", 1)
            tag2 = self.r.choice(["b", "i", "em", "strong", "span"])
            body = f"<{tag2}>{a}</{tag2}> {b}"
        return f"<{tag}{attrs}>{mark}{body}" + (f"</{tag}>" if close else "")

    def links(self, n: int, main: bool = False) -> str:
        out = []
        for _ in range(n):
            out.append(self.block("a", self.text(1, 4), main, ' href="/x"'))
        return "".join(f"<li>{x}</li>" for x in out)

    def name(self, kind: str) -> str:
        names = MAIN if kind == "main" else ASIDE[kind]
        if self.r.random() < 0.2:
            return ""
        name = self.odd_name() if self.mute else self.r.choice(names)
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def odd_name(self) -> str:
        """A name that nothing can be known from."""
        return self.r.choice(["css-", "x", "c_", "wq"]) + "".join(self.r.choices("bcdfgkmqxz0123456789", k=5))

    def part(self, kind: str) -> str:
        r, tag = self.r, self.r.choice(TAGS[kind])
        plain = tag in ("div", "section", "ul", "ol")
        attrs = self.name(kind)
        if plain and self.claimed and r.random() < 0.4:  # what it is then follows from where the article is
            attrs = f' class="{self.odd_name()}"'
        elif plain and (not attrs or not self.claimed):
            attrs = f' class="{r.choice(ASIDE[kind])}"'
        if kind == "menu":
            inner = self.links(r.randint(3, 9))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "comments":
            inner = "".join(f'<{t}>{self.block("p", self.text(5, 60), False)}</{t}>' for t in [r.choice(["div", "li"])] * r.randint(1, 5))
            inner = self.block(r.choice(["h2", "h3"]), r.choice(["Comments", "Kommentare", self.text(1, 2)]), False) + inner
        elif kind == "form":
            inner = self.block("label", self.text(1, 3), False) + '<input type="text">' + self.block("button", self.text(1, 2), False)
        elif kind == "sidebar":
            inner = self.block("h3", self.text(1, 4), False) + (f"<ul>{self.links(r.randint(2, 6))}</ul>" if r.random() < 0.7 else self.block("p", self.text(5, 40), False))
        elif kind == "footer":
            inner = r.choice(["&copy; ", ""]) if r.random() < 0.7 else self.block("p", self.text(2, 10), False)
            inner += f"{OTHER}{self.text(1, 3)} &middot; {escape(self.text(3, 25))}"
        elif kind == "header":
            inner = self.block(r.choice(["h1", "div", "p", "a"]), self.text(1, 5), False) + (f"<nav><ul>{self.links(4)}</ul></nav>" if r.random() < 0.4 else "")
        else:
            inner = r.choice([OTHER + escape(self.text(3, 30)), self.block("p", self.text(3, 40), False)])
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = self.block(r.choice(["h1", "h1", "h2"]), self.text(2, 14), True)
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            roll = r.random()
            if roll < 0.7:
                sloppy = r.random() < 0.2
                out.append(self.block("p", self.text(1, r.choice([4, 20, 80])), True, close=not sloppy))
                if sloppy and r.random() < 0.5:
                    out.append("<br>")
            elif roll < 0.77:
                out.append(self.block(r.choice(["h2", "h3"]), self.text(1, 8), True))
            elif roll < 0.84:
                out.append("<ul>" + "".join(self.block("li", self.text(2, 15), True) for _ in range(r.randint(2, 5))) + "</ul>")
            elif roll < 0.87:
                out.append("<blockquote>" + self.block("p", self.text(5, 30), True) + "</blockquote>")
            elif roll < 0.89:
                out.append("<table><tr>" + "".join(self.block("td", self.text(1, 4), True) for _ in range(3)) + "</tr></table>")
            elif roll < 0.96:
                claimed, self.claimed = self.claimed, False  # inside the article a name must tell
                out.append(self.part(r.choice(["advert", "notice", "sidebar", "form"])))
                self.claimed = claimed
            elif roll < 0.975:
                out.append(f'<div class="{self.odd_name()}">' + self.block("p", self.text(5, 60), True) + "</div>")
            else:
                out.append(self.block("pre", self.text(4, 20), True))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        kinds = [k for k in ("notice", "header", "menu", "advert", "sidebar") if r.random() < 0.55]
        r.shuffle(kinds)
        after = [k for k in ("comments", "sidebar", "advert", "form", "notice", "menu") if r.random() < 0.3]
        r.shuffle(after)
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        attrs = self.name("main")
        if tag in ("div", "section") and (self.mute or not attrs):
            attrs = f' class="{r.choice(MAIN)}"'
        plain = r.random()
        self.claimed = plain >= 0.2
        if plain < 0.1:  # nothing says where the article is
            body = self.article()
        elif plain < 0.2:
            body = f"<{(tag := r.choice(['div', 'section']))}>{self.article()}</{tag}>"
        else:
            body = f"<{tag}{attrs}>{self.article()}</{tag}>"
        if r.random() < 0.35:
            body = f'<{r.choice(["main", "div"])} class="{r.choice(["wrapper", "container", "row", "page"])}">{body}' + "</div>" * (r.random() < 0.9)
        foot = self.part("footer") if r.random() < 0.85 else ""
        return "<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>" + "".join(map(self.part, kinds)) + body + "".join(map(self.part, after)) + foot + "</body></html>"


def labelled_pages(n: int, seed: int = 17) -> list[str]:
    """``n`` pages; in front of each block's text stands U+E000 if it belongs to the article, else U+E001."""
    return [Maker(seed * 100_003 + i).page() for i in range(n)]
