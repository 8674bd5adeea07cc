"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: stretches of text without a block tag between them. Each block has features of its
ancestors (tags, and words of their classes and ids), of its own tag and text, of its place, and of the rest of the page:
whether something on it claims to be the article, where most of the text stands, and the neighbours. A chain model
with two labels, article and other, is trained by maximum likelihood (forward-backward, L2) on labelled pages, on many of
which names say nothing; Viterbi decoding gives the blocks to keep.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, new_key, once_per_process
from .pages import ARTICLE, ASIDE, MAIN, OTHER, labelled_pages

# HTML's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math head title iframe object select textarea canvas audio video datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""=\s*["']|>""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
NAMES = frozenset(w for group in (MAIN, *ASIDE.values()) for name in group for w in name.split("-"))
ROOT = ("html", "body")
# The tags that can stand in a head; any other ends one that is open.
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes head html".split())
# Tags that a sibling ends without an end tag (tag: the tags it ends), and those that such an end never reaches beyond.
SIBLINGS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "table", "dl"), "tr": ("ul", "ol", "table", "dl"), "td": ("ul", "ol", "table", "dl", "tr"), "dd": ("ul", "ol", "table", "dl"), "option": ("ul", "ol", "table", "dl")}
GROUP = {"li": "li", "tr": "tr", "td": "td", "th": "td", "dd": "dd", "dt": "dd", "option": "option"}
GROUPS = tuple(FENCES)


def words_of_names(attrs: str) -> tuple[str, ...]:
    """Known words in class, id and role."""
    out = []
    for _, value in NAMED.findall(attrs):
        out += [w for w in re.split(r"[^a-z0-9]+", value.strip("\"'").lower()) if w in NAMES]
    return tuple(dict.fromkeys(out))


class Node:
    """An open element: what its ancestors' tags and names say, handed down step by step so that a block needs no walk up."""

    __slots__ = ("tag", "names", "solid", "deep", "said", "inner", "holder", "linked", "p", "last", "chars", "beneath", "score")

    def __init__(self, tag: str, names: tuple[str, ...], above: "Node | None", at: int):
        self.tag, self.names = tag, names
        inline, root = tag in INLINE, tag in ROOT
        #: what was said so far; shared with the parent where this element says nothing new
        said = above.said if above else frozenset(("bias",))
        new = set() if root else {"in " + tag if tag in KNOWN_TAGS else "in other", *("name " + n for n in names)}
        if any(n in _WORDS[k] for k in ASIDE for n in names):
            new.add("any aside")
        if any(n in _WORDS["main"] for n in names):
            new.add("any main")
        self.said = said if new <= said else said | new
        #: nearest ancestor or self that is no inline element
        self.solid = self if above is None or not (inline or root) else above.solid
        self.deep = (above.deep if above else 0) + (not inline and not root)
        #: the innermost ancestor whose tag or names say what it is
        kinds = {"main"} if tag in HOLDERS else {"other"} if tag in ("nav", "header", "footer", "aside", "form", "ins") else set()
        kinds |= {"main" if n in _WORDS["main"] else "other" for n in names}
        self.holder = bool(above and above.holder) or tag in HOLDERS
        if kinds:
            self.inner = "inner " + "+".join(sorted(kinds)) + (f", {tag} of article" if tag in ("header", "footer") and self.holder else "")
        else:
            self.inner = above.inner if above else "inner none"
        self.linked = bool(above and above.linked) or tag == "a"
        # where an end tag that was left out would be put: the nearest open p, and the nearest element of each kind of sibling
        self.p = at if tag == "p" else above.p if above and inline else -1
        self.last = above.last if above else dict.fromkeys(GROUPS, -1)
        fenced = [g for g in GROUPS if tag in FENCES[g]]
        if fenced or tag in GROUP:
            self.last = {g: -1 if g in fenced else v for g, v in self.last.items()}
            if tag in GROUP:
                self.last[GROUP[tag]] = at
        self.chars, self.beneath, self.score = 0, above.solid if above else None, None


class Block:
    """A leaf block: its text, its innermost element, and how much of it is in links."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: float):
        self.node, self.text, self.linked = node, text, linked

    def __iter__(self):  # element, text, links
        return iter((self.node, self.text, self.linked))


def leaf_blocks(html: str) -> list[Block]:
    """Every leaf block that has text, in one pass whose time is linear in the page, however odd its markup."""
    top = Node("html", (), None, -1)
    stack: list[Node] = []
    opened: dict[str, int] = {}
    blocks, parts, own, linked, quiet = [], [], top, 0, 0
    length, at, loose = len(html), 0, False

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(own, text, linked / max(1, sum(map(len, parts)))))
            own.solid.chars += len(text)
        parts, linked = [], 0

    def add(raw: str):
        nonlocal own, linked
        if quiet and stack[-1].tag == "head" and raw.strip():
            leave_head()
        if quiet or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        here = stack[-1] if stack else top
        if not parts:
            own = here
        parts.append(text)
        if here.linked:
            linked += len(text)

    def leave_head():
        if opened.get("head"):
            pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "head"))

    def pop(k: int):
        nonlocal quiet
        for node in stack[k:]:
            quiet -= node.tag in SILENT
            opened[node.tag] -= 1
        del stack[k:]

    def tag_end(begin: int) -> int:
        """Where the tag's > stands, quoted values passed over; -1 if there is none. A quote that isn't closed is no quote."""
        nonlocal loose
        pos = begin
        while not loose:
            m = STOP.search(html, pos)
            if not m:
                loose = True  # from here on, tags end at the first >
                break
            if m[0] == ">":
                return m.start()
            close = html.find(m[0][-1], m.end())
            if close < 0:
                loose = True
                break
            pos = close + 1
        return html.find(">", begin)

    while at < length:
        begin = html.find("<", at)
        if begin < 0:
            add(html[at:])
            break
        first = html[begin + 1 : begin + 2]
        if first in ("!", "?"):
            add(html[at:begin])
            if html.startswith("<!--", begin):
                end, skip = html.find("-->", begin + 4), 3
            elif html.startswith("<![CDATA[", begin):
                end, skip = html.find("]]>", begin + 9), 3
                add(html[begin + 9 : end if end >= 0 else length])
            else:
                end, skip = html.find(">", begin), 1
            at = end + skip if end >= 0 else length
            continue
        closing = first == "/"
        m = NAME.match(html, begin + 1 + closing)
        end = tag_end(m.end()) if m else -1
        if end < 0:  # no tag: text
            if m:  # and no > comes any more, so no tag either
                add(html[at:])
                break
            add(html[at : begin + 1])
            at = begin + 1
            continue
        add(html[at:begin])
        at = end + 1
        tag, attrs = m[0].lower(), html[m.end() : end]
        if tag not in INLINE:
            flush()
        if closing:
            if opened.get(tag):
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if quiet and tag not in IN_HEAD:
            leave_head()
        if tag in VOID:
            continue
        if tag in RAW:
            close = ENDS[tag].search(html, at)
            at = close.end() if close else length
            continue
        if stack:
            if tag in CLOSES_P and stack[-1].p >= 0:
                pop(stack[-1].p)
            elif tag in GROUP and stack[-1].last[GROUP[tag]] >= 0:
                pop(stack[-1].last[GROUP[tag]])
        if not attrs.rstrip().endswith("/") or tag not in SILENT:
            stack.append(Node(tag, words_of_names(attrs) if attrs else (), stack[-1] if stack else top, len(stack)))
            opened[tag] = opened.get(tag, 0) + 1
            quiet += tag in SILENT
    flush()
    return blocks


_WORDS = {k: {w for n in v for w in n.split("-")} for k, v in {**ASIDE, "main": MAIN}.items()}
HOLDERS = ("article", "main")
KNOWN_TAGS = INLINE | CLOSES_P | SILENT | frozenset("article main section div p li td th tr body html dd dt tbody thead tfoot caption figure button label legend summary slot".split())


def path_features(node: Node) -> list[str]:
    """What a block's ancestors say."""
    solid = node.solid
    own = "none" if solid.deep == 0 else solid.tag if solid.tag in KNOWN_TAGS else "other"
    out = [*node.said, "own " + own, "deep " + str(min(node.deep, 6)), node.inner]
    if node.inner.startswith("inner none"):
        out.append("inner none, own " + own)
    if node.inner.endswith("of article"):
        out.append(node.inner + ", own " + own)
    return sorted(out)


def page_features(blocks: list[Block]) -> list[list[str]]:
    """For each block what the rest of the page says: whether something on it claims to be the article, where most of the text is, and the neighbours."""
    total = max(1, sum(len(b.text) for b in blocks))
    claimed = sum(len(b.text) for b in blocks if b.node.holder)
    named = sum(len(b.text) for b in blocks if b.node.inner == "inner main")
    page = "article " + ("none" if not claimed else "some" if claimed < total / 4 else "most")
    most = max([b.node.solid.chars for b in blocks], default=1)
    above: dict[int, int] = {}
    for node in {id(b.node.solid): b.node.solid for b in blocks}.values():
        up = node.beneath or node
        above[id(up)] = above.get(id(up), 0) + node.chars
    crowd = max(above.values(), default=1)
    out = []
    for i, b in enumerate(blocks):
        solid, up = b.node.solid, b.node.solid.beneath or b.node.solid
        got = [f"{page}, {'in' if b.node.holder else 'out'}"]
        if named:
            got.append(f"main named, {b.node.inner}")
        share, around = 4 * solid.chars // most, 4 * above[id(up)] // crowd
        got += [f"share {share}", f"around {around}", f"{page}, around {around}, {'in' if b.node.holder else 'out'}"]
        for side, j in (("before", i - 1), ("after", i + 1)):
            other = blocks[j] if 0 <= j < len(blocks) else None
            got.append(f"{side} " + ("none" if other is None else f"{min(len(other.text).bit_length(), 8) // 2} {int(other.linked * 2)} {'same' if other.node.solid.beneath is solid.beneath else 'else'}"))
        out.append(got)
    return out


def text_features(text: str, linked: float, i: int, n: int) -> list[str]:
    size = len(text)
    out = ["size " + str(min(size.bit_length(), 9)), "linked " + str(int(linked * 4)), "place " + str(4 * i // max(n, 1))]
    if i == 0:
        out.append("first")
    if i == n - 1:
        out.append("last")
    if text[:1] == "©" or "©" in text:
        out.append("copyright")
    if text[-1:] in ".!?":
        out.append("sentence")
    return out


class Crf:
    """Weights of features for (article minus other), and of the four transitions."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray):
        self.weights, self.transitions = weights, transitions

    def emission(self, blocks: list[Block]) -> list[float]:
        get, out, n = self.weights.get, [], len(blocks)
        for i, (b, around) in enumerate(zip(blocks, page_features(blocks), strict=True)):
            if b.node.score is None:
                b.node.score = sum([get(f, 0.0) for f in path_features(b.node)])
            out.append(b.node.score + sum([get(f, 0.0) for f in around]) + sum([get(f, 0.0) for f in text_features(b.text, b.linked, i, n)]))
        return out

    def decode(self, blocks) -> list[bool]:
        """Viterbi; ties go to article."""
        if not blocks:
            return []
        (oo, oa), (ao, aa) = self.transitions.tolist()
        other, article, back = 0.0, 0.0, []
        for i, e in enumerate(self.emission(blocks)):
            if i:
                from_o, from_a = article + aa >= other + oa, article + ao >= other + oo
                back.append((from_a, from_o))
                other, article = (article + ao if from_a else other + oo), (article + aa if from_o else other + oa) + e
            else:
                article = e
        label = article >= other
        out = [label]
        for to_other, to_article in reversed(back):
            label = to_article if label else to_other
            out.append(label)
        return out[::-1]


def train(pages: list[str], steps: int = 200, penalty: float = 1e-4) -> Crf:
    """Maximum likelihood on marked pages (see :mod:`axisframe.llm.pages`) by gradient ascent with Adam steps."""
    vocabulary: dict[str, int] = {}
    rows, cols, labels, firsts, lens = [], [], [], [], []
    n = 0
    for page in pages:
        blocks, found = [], []
        for b in leaf_blocks(page):
            mark = next((c for c in b.text if c in (ARTICLE, OTHER)), None)
            clean = " ".join(b.text.replace(ARTICLE, "").replace(OTHER, "").split())
            if mark and clean:
                blocks.append(Block(b.node, clean, b.linked))
                found.append(mark == ARTICLE)
        if not blocks:
            continue
        firsts.append(n)
        lens.append(len(blocks))
        for i, (b, around) in enumerate(zip(blocks, page_features(blocks), strict=True)):
            for f in path_features(b.node) + around + text_features(b.text, b.linked, i, len(blocks)):
                rows.append(n)
                cols.append(vocabulary.setdefault(f, len(vocabulary)))
            n += 1
        labels += found
    y = np.array(labels, float)
    rows, cols = np.array(rows), np.array(cols)
    lens, firsts = np.array(lens), np.array(firsts)
    longest, k = int(lens.max()), len(vocabulary)
    place = np.full((len(lens), longest), -1)
    for p, (f, length) in enumerate(zip(firsts, lens, strict=True)):
        place[p, :length] = np.arange(f, f + length)
    real = place >= 0
    gold = np.zeros((2, 2))
    pair = real[:, 1:]
    a, b = y[place[:, :-1][pair]].astype(int), y[place[:, 1:][pair]].astype(int)
    np.add.at(gold, (a, b), 1)
    theta, first, second = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, steps + 1):
        emission = np.bincount(rows, theta[cols], n)
        trans = theta[k:].reshape(2, 2)
        e = np.zeros((len(lens), longest, 2))
        e[..., 1] = np.where(real, emission[place], 0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + e[:, t + 1]
            new = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        prob = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
        expected = np.zeros((2, 2))
        for i in range(2):
            for j in range(2):
                lp = alpha[:, :-1, i] + trans[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None]
                expected[i, j] = np.exp(np.where(pair, lp, -np.inf)).sum()
        miss = np.zeros(n)
        miss[place[real]] = y[place[real]] - prob[real]
        grad = np.concatenate([np.bincount(cols, miss[rows], k), (gold - expected).ravel()]) / n - penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta += 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Crf({f: float(theta[i]) for f, i in vocabulary.items()}, theta[k:].reshape(2, 2))


def main_text(html: str | None, model: Crf) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


@cache
def fit(pages: int = 1000) -> Crf:
    """The model trained on ``pages`` made-up labelled pages; the same on every run."""
    return train(labelled_pages(pages))


def extract(pages: DataFrame, model: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (main text, empty if none), ``n_chars`` (its code points).

    Null html counts as empty. Blocks keep the page's order and are joined by one space; white space (any Unicode
    white space) inside a block becomes one space. Character references are decoded. Malformed markup is read as far
    as it goes: unclosed tags end with the page, a head at the first tag or text that can't stand in it, an unclosed
    comment or script hides the rest; after a quoted value that never ends, tags end at the first ``>``. Pages of any
    length are read whole, in time linear in their length. Repeated rows are each read; other columns are ignored; an
    empty table gives an empty one.
    """
    weights = pages.sparkSession.sparkContext.broadcast((model.weights, model.transitions))
    key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = once_per_process("html", key, lambda: Crf(*weights.value))
        for batch in batches:
            texts = [main_text(h.as_py(), crf) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

    pick = pages.select(id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in pick.schema]
    return pick.mapInArrow(lean(run), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
