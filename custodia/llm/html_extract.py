"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is read into its block-level elements. Trees score each as main text or not from its tag, depth, link
and text density of its subtree, attribute tokens of its own and of its ancestors, and how it stands among its
siblings. Decoding then picks, from the leaves up, whether a whole subtree is kept, dropped or split into its
children, whichever the scores of its nodes make likeliest; so nothing is kept below a dropped node, or dropped
below a kept one. The trees are trained on generated pages (``training_pages``) of many layouts, each block of
which is known to be main text or not.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import ready

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never text of the page.
SILENT = frozenset("script style noscript template title iframe object svg math select textarea button datalist canvas audio video".split())
#: Of these, the ones whose content no end tag but their own reaches out of; foreign ones, which may close themselves.
SEALED = frozenset("script style noscript template title iframe object textarea".split())
FOREIGN = ("svg", "math")
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                     "hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
GROUPS = ({"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section"}, {"article", "main"}, {"nav"}, {"header"},
          {"footer"}, {"aside"}, {"form", "fieldset", "dialog"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre"}, {"figure", "figcaption"}, {"body", "html"})
SPACE = re.compile(r"\s+")
#: Elements whose content is characters up to their own end tag, with that end.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title")}
_TAG = re.compile(r"[a-zA-Z][^\s/>\x00]*")
#: An attribute's name, behind white space and slashes; its equals sign; a value without quotes.
_NAME, _EQUALS, _BARE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
_TAIL = re.compile(r"[\s/]*>")


class Page:
    """Block-level elements in page order, and the runs of text between their tags.

    nodes: tag, parent, tokens; runs: owner and text, link characters. Missing ends are implied. Markup is read as
    browsers read it, in one scan without a step back: a comment, tag or quoted value that never ends reaches to the
    end of the page, so that it is text to no reader.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.tokens = ["#page"], [-1], [()]
        self.runs: list[list] = []  # owner, pieces, link characters
        self.open = [("#page", 0)]  # element and its block node
        self.held: Counter = Counter()  # open elements by tag, so that a stray end needs no search
        self.links, self.silent, self.fresh = 0, 0, True
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                self.handle_data(unescape(html[at:mark]))
            after = html[mark + 1:mark + 2]
            if not after:
                if mark < size:
                    self.handle_data("<")
                return
            if after.isascii() and after.isalpha():
                at = self._start_tag(html, mark)
            elif after == "/":
                at = self._end_tag(html, mark)
            elif after == "!" and html.startswith("--", mark + 2):
                at = self._comment(html, mark)
            elif after in "!?":
                at = html.find(">", mark) + 1 or size
            else:
                self.handle_data("<")
                at = mark + 1

    @staticmethod
    def _comment(html: str, mark: int) -> int:
        """Where a comment ends: at ``-->`` or ``--!>``, or at once in ``<!-->`` and ``<!--->``."""
        for short in (">", "->"):
            if html.startswith(short, mark + 4):
                return mark + 4 + len(short)
        at = mark + 4
        while True:
            at = html.find("--", at)
            if at < 0:
                return len(html)
            for end in ("-->", "--!>"):
                if html.startswith(end, at):
                    return at + len(end)
            at += 1

    def _end_tag(self, html: str, mark: int) -> int:
        name = _TAG.match(html, mark + 2)
        if name is None:  # no tag: passed over up to its end
            return html.find(">", mark) + 1 or len(html)
        at, _, _ = self._attributes(html, name.end())
        if at:
            self.handle_endtag(name[0].lower())
        return at or len(html)

    def _start_tag(self, html: str, mark: int) -> int:
        name = _TAG.match(html, mark + 1)
        tag = name[0].lower()
        at, attrs, closed = self._attributes(html, name.end())
        if not at:
            return len(html)
        if closed:
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
        if tag in RAW and not any(self.held[t] for t in FOREIGN):
            end = RAW[tag].search(html, at)
            return end.start() if end else len(html)
        return at

    @staticmethod
    def _attributes(html: str, at: int) -> tuple[int, list[tuple[str, str | None]], bool]:
        """Where the tag ends (0: never), its attributes, and whether it closes itself."""
        attrs = []
        while True:
            tail = _TAIL.match(html, at)
            if tail:
                return tail.end(), attrs, html[tail.end() - 2] == "/"
            name = _NAME.match(html, at)
            if name is None:
                return 0, attrs, False
            at, value = name.end(), None
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at:at + 1]
                if quote in ('"', "'") and quote:
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return 0, attrs, False
                    value, at = html[at + 1:end], end + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            attrs.append((name[1].lower(), unescape(value) if value else value))

    def handle_starttag(self, tag, attrs):
        if self.silent:
            # no nodes, but the tags are kept, so that their ends close them and nothing outside
            if tag not in VOID:
                self.open.append((tag, self.open[-1][1]))
                self.held[tag] += 1
                self.silent += tag in SILENT
            return
        if tag in CLOSES_P:
            self._close_to("p", ("table", "td", "th", "caption", "button"))
        if tag in SAME:
            for t in SAME[tag]:
                self._close_to(t, WALLS[tag])
        if tag in INLINE:
            if tag == "br" and not self.fresh:
                self.runs[-1][1].append(" ")
            if tag not in VOID:
                self.open.append((tag, self.open[-1][1]))
                self.held[tag] += 1
                self.links += tag == "a"
            return
        self.fresh = True
        if tag in VOID:
            return
        words = []
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                words += re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and re.search(r"display\s*:\s*none", value)):
                words.append("#hidden")
        self.tags.append(tag)
        self.parents.append(self.open[-1][1])
        self.tokens.append(tuple(sorted({w for w in words if w})))
        self.open.append((tag, len(self.tags) - 1))
        self.held[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        if any(self.held[t] for t in FOREIGN):
            return
        self.handle_starttag(tag, attrs)
        if tag in FOREIGN:
            self._close_to(tag, ())

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self._close_to(tag, () if tag in ("body", "html") else ("body",))

    def _close_to(self, tag, walls):
        # block ends close all inside them; an inline end stops at a block
        if not self.held[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                for gone, _ in reversed(self.open[i:]):
                    self.held[gone] -= 1
                    self.links -= gone == "a" and not self.silent  # links inside silent elements are not counted
                    self.silent -= gone in SILENT
                    self.fresh |= gone not in INLINE
                del self.open[i:]
                return
            if name in walls or name in SEALED or (tag in INLINE and name not in INLINE):
                return

    def handle_data(self, data):
        if self.silent or not data:
            return
        if self.fresh:
            self.runs.append([self.open[-1][1], [], 0])
            self.fresh = False
        self.runs[-1][1].append(data)
        if self.links > 0:
            self.runs[-1][2] += len(data.strip())

    def blocks(self) -> list[tuple[int, str, int]]:
        """(owner, text with single spaces, link characters) of the runs that hold text."""
        out = []
        for owner, pieces, linked in self.runs:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append((owner, text, linked))
        return out


def features(page: Page, blocks: list, odds: dict[str, float]) -> np.ndarray:
    """A row per node of ``page``."""
    n = len(page.tags)
    parent = page.parents
    depth, inside_bad, inside_good, sib, nsib = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    own, worst, best = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n):
        words = page.tokens[i]
        own[i] = min(max(sum(odds.get(w, 0.0) for w in words), -6.0), 6.0)
        if i:
            q = parent[i]
            depth[i] = depth[q] + 1
            inside_bad[i] = inside_bad[q] or page.tags[q] in ("nav", "footer", "aside", "form", "header", "dialog")
            inside_good[i] = inside_good[q] or page.tags[q] in ("article", "main")
            worst[i], best[i] = min(worst[q], own[q]), max(best[q], own[q])
            sib[i] = nsib[q]
            nsib[q] += 1
    chars, links, stops, count, first, mine = ([0] * n for _ in range(6))
    seen = 0
    for owner, text, linked in blocks:
        mine[owner] += len(text)
        chars[owner] += len(text)
        links[owner] += linked
        stops[owner] += len(re.findall(r"[.!?](?:\s|$)", text))
        if not count[owner]:
            first[owner] = seen
        count[owner] += 1
        seen += len(text)
    kids = [0] * n
    for i in range(n - 1, 0, -1):
        q = parent[i]
        if count[i]:
            first[q] = min(first[q], first[i]) if count[q] else first[i]
        chars[q] += chars[i]
        links[q] += links[i]
        stops[q] += stops[i]
        count[q] += count[i]
        kids[q] += 1 + kids[i]
    q = np.maximum(np.array(parent), 0)
    c, k = np.array(chars, float), np.array(kids, float)
    near = np.array(nsib, float)[q]
    cols = [np.array([t in g for t in page.tags], float) for g in GROUPS]
    cols += [np.minimum(np.array(depth, float), 30), np.log1p(c), np.array(links) / np.maximum(c, 1), np.log1p(np.array(count, float)),
             np.log1p(c / (1 + k)), np.log1p(np.array(mine, float)), np.array(stops) / np.maximum(c, 1) * 100,
             np.log1p(near), np.array(sib) / np.maximum(near, 1), c / np.maximum(c[q], 1), np.log1p(c[q] / np.maximum(near, 1)),
             np.array(links)[q] / np.maximum(c[q], 1), np.array(first) / max(1, seen), c / max(1, seen),
             np.array(own), np.array(worst), np.array(best), np.array(inside_bad, float), np.array(inside_good, float),
             np.array(["#hidden" in t for t in page.tokens], float)]
    return np.stack(cols, 1)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on features cut into quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        z = self._binned(x)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees = []
        f = np.full(len(y), self.start)
        size = 2 ** self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(size - 1, np.int64), np.full(size - 1, 255)  # a bin above all: everything goes left
            for level in range(self.depth):
                base, wide = 2 ** level - 1, 2 ** level
                gain = np.full(wide, 1e-6)
                spot = node - base
                for j in range(z.shape[1]):
                    key = spot * self.bins + z[:, j]
                    gs = np.bincount(key, g, wide * self.bins).reshape(wide, -1).cumsum(1)
                    hs = np.bincount(key, h, wide * self.bins).reshape(wide, -1).cumsum(1)
                    rg, rh = gs[:, -1:] - gs, hs[:, -1:] - hs
                    score = gs ** 2 / (hs + self.ridge) + rg ** 2 / (rh + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    at = score.argmax(1)
                    top = score[np.arange(wide), at]
                    better = top > gain
                    gain[better] = top[better]
                    feature[base:base + wide][better] = j
                    cut[base:base + wide][better] = at[better]
                node = 2 * node + 1 + (z[np.arange(len(z)), feature[node]] > cut[node])
            leaf = node - (size - 1)
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            f += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, col, "left") for e, col in zip(self.edges, x.T, strict=True)], 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = self._binned(x)
        f, rows = np.full(len(z), self.start), np.arange(len(z))
        for feature, cut, value in self.trees:
            node = np.zeros(len(z), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (z[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return f


def decode(parents: list[int], logit: np.ndarray, weight: np.ndarray, change: float = 0.7) -> np.ndarray:
    """Which nodes are kept, given each node's logit: the likeliest choice of whole kept, whole dropped and split subtrees.

    weight counts a node's evidence (0 for nodes without text). A split node stands for its own text only.
    ``change`` is what a split costs.
    """
    n = len(parents)
    yes, no = -np.logaddexp(0, -logit) * weight, -np.logaddexp(0, logit) * weight
    keep, drop, split = yes.copy(), no.copy(), np.maximum(yes, no) - change
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] = max(keep[i], drop[i], split[i])
        if i:
            q = parents[i]
            keep[q] += keep[i]
            drop[q] += drop[i]
            split[q] += best[i]
    out = np.zeros(n, bool)
    state = [""] * n
    for i in range(n):
        above = state[parents[i]] if i else "split"
        if above != "split":
            state[i] = above
        elif split[i] > max(keep[i], drop[i]):
            state[i] = "split"
        else:
            state[i] = "keep" if keep[i] >= drop[i] else "drop"
        out[i] = state[i] == "keep" or (state[i] == "split" and logit[i] > 0)
    return out


class Extractor:
    """Token odds and trees; made on the driver, shipped to the tasks."""

    def __init__(self, odds: dict[str, float], trees: Trees):
        self.odds, self.trees = odds, trees

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page: its blocks in page order, one a line."""
        parsed, rows = [], []
        for html in pages:
            page = Page(html)
            blocks = page.blocks()
            parsed.append((page, blocks))
            if blocks:
                rows.append(features(page, blocks, self.odds))
        logits = self.trees.logit(np.concatenate(rows)) if rows else np.zeros(0)
        out, at = [], 0
        for page, blocks in parsed:
            if not blocks:
                out.append("")
                continue
            n = len(page.tags)
            kept = decode(page.parents, logits[at:at + n], has_text(page, blocks))
            at += n
            out.append("\n".join(text for owner, text, _ in blocks if kept[owner]))
        return out


def has_text(page: Page, blocks: list) -> np.ndarray:
    """1 for nodes with text in their subtree; the page itself is no evidence."""
    out = np.zeros(len(page.tags))
    out[[owner for owner, _, _ in blocks]] = 1
    for i in range(len(page.tags) - 1, 0, -1):
        if out[i]:
            out[page.parents[i]] = 1
    for i, tag in enumerate(page.tags):
        if tag in ("#page", "html", "body"):
            out[i] = 0
    return out


def training_pages(n: int, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Generated pages, each with the set of its main text's blocks (every block of a page is unique)."""
    draw = random.Random(seed)
    names = {
        "content": ("content", "article-body", "post", "entry-content", "story", "main-content", "text", "post-content", "articleBody", "page-content"),
        "nav": ("nav", "menu", "navbar", "main-navigation", "topnav", "breadcrumbs", "links"), "header": ("header", "site-header", "masthead", "top-bar", "branding"),
        "footer": ("footer", "site-footer", "copyright", "bottom", "colophon", "legal"), "aside": ("sidebar", "aside", "widget", "related", "recommended", "side-bar", "teaser"),
        "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"), "notice": ("cookie-notice", "notice", "alert", "consent", "gdpr-banner", "popup", "overlay", "modal"),
        "comments": ("comments", "comment-list", "responses", "discussion", "replies", "disqus-thread"), "share": ("share", "social", "share-buttons", "follow-us"),
        "form": ("newsletter", "subscribe", "search", "signup", "login-form", "contact-form"), "pages": ("pagination", "pager", "page-links", "tags", "meta", "byline")}
    serial = [0]

    def words(k: int) -> str:
        return " ".join("".join(draw.choice(("th", "er", "on", "an", "re", "es", "al", "la", "ment", "ing", "un", "é", "ä", "que", "lich")) for _ in range(draw.randint(1, 4))) for _ in range(k))

    def phrase(lo: int, hi: int) -> str:
        serial[0] += 1
        return f"{words(draw.randint(lo, hi)).capitalize()} {serial[0]}"

    def prose(k: int) -> str:
        return " ".join(phrase(4, 18) + draw.choice((".", ".", ".", "!", "?")) for _ in range(k))

    def inner(text: str) -> str:
        if draw.random() < 0.25:
            head, _, rest = text.partition(" ")
            tag = draw.choice(("b", "em", 'a href="/x"', "span", "strong"))
            return f"<{tag}>{escape(head)}</{tag.split()[0]}> {escape(rest)}"
        return escape(text)

    def attr(kind: str, share: float = 0.85) -> str:
        return f' {draw.choice(("class", "class", "id"))}="{draw.choice(names[kind])}"' if draw.random() < share else ""

    for _ in range(n):
        main: set[str] = set()

        def good(text: str, main=main) -> str:
            main.add(text)
            return inner(text)

        def links(k: int) -> str:
            item = lambda: f'<a href="/{serial[0]}">{phrase(1, 4)}</a>'
            shape = draw.random()
            if shape < 0.5:
                return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(k)) + "</ul>"
            return " | ".join(item() for _ in range(k)) if shape < 0.75 else "".join(f"<p>{item()}</p>" for _ in range(k))

        def body(depth: int = 0) -> str:
            out = []
            for _ in range(draw.choice((0, 1, 1, 2, 3, 5, 8, 12)) or (depth and 1) or 1):
                kind = draw.random()
                if kind < 0.72:
                    end = draw.choice(("</p>", "</p>", ""))
                    out.append(f"<p>{good(prose(draw.choice((1, 1, 2, 4, 7))))}{end}")
                elif kind < 0.79:
                    out.append(f"<h{2 + depth}>{good(phrase(2, 8))}</h{2 + depth}>")
                elif kind < 0.86:
                    tag = draw.choice(("ul", "ol"))
                    out.append(f"<{tag}>" + "".join(f"<li>{good(prose(1) if draw.random() < 0.6 else phrase(2, 8))}</li>" for _ in range(draw.randint(2, 6))) + f"</{tag}>")
                elif kind < 0.91:
                    out.append(f"<blockquote><p>{good(prose(2))}</p></blockquote>" if draw.random() < 0.5 else f"<pre>{good(prose(2))}</pre>")
                elif kind < 0.94:
                    out.append("<table>" + "".join("<tr>" + "".join(f"<td>{good(phrase(1, 5))}</td>" for _ in range(3)) + "</tr>" for _ in range(draw.randint(2, 4))) + "</table>")
                elif kind < 0.96:
                    out.append(f"<figure><img src=x><figcaption>{good(prose(1))}</figcaption></figure>")
                elif kind < 0.98 and depth < 2:
                    out.append(f"<{draw.choice(('div', 'section'))}>{body(depth + 1)}" + "</div>")
                else:
                    out.append(f"<div{attr('ad', 1)}>{inner(prose(1) if draw.random() < 0.6 else phrase(2, 8))}</div>")
            return "".join(out)

        def bad(kind: str) -> str:
            tag, own = {"nav": ("nav", links(draw.randint(3, 9))), "header": ("header", f"<div>{phrase(1, 4)}</div>" + draw.choice(("", links(4), f"<p>{phrase(3, 8)}</p>"))),
                        "footer": ("footer", draw.choice((f"&copy; {phrase(1, 3)} &middot; {prose(1)}", f"<p>&copy; {phrase(2, 5)}</p>{links(3)}", f"{prose(2)}"))),
                        "aside": ("aside", f"<h3>{phrase(1, 3)}</h3>" + draw.choice((links(5), f"<p>{prose(1)}</p>", links(3)))), "ad": ("div", draw.choice((inner(prose(1)), f"<p>{inner(prose(2))}</p>", f'<a href="/b">{phrase(2, 6)}</a>', inner(phrase(2, 8))))),
                        "notice": ("div", draw.choice((f"<p>{prose(2)}</p><button>OK</button>", prose(1), f'{prose(1)} <a href="/p">{phrase(1, 3)}</a>'))),
                        "comments": ("section", f"<h3>{phrase(1, 3)}</h3>" + "".join(
                            f'<{ct}{draw.choice((" class=comment", " class=reply", ""))}>{draw.choice(("", f"<b>{phrase(1, 2)}</b>", f"<div class=author>{phrase(1, 2)}</div>"))}<p>{prose(draw.choice((1, 1, 2, 3)))}</p></{ct}>'
                            for ct in [draw.choice(("div", "li", "article"))] * draw.randint(1, 5))),
                        "share": ("div", links(3)), "form": ("form", f"<label>{phrase(1, 4)}</label><input name=q><p>{prose(1)}</p><button>Go</button>"),
                        "pages": ("div", draw.choice((links(4), f"<span>{phrase(1, 3)}</span> {phrase(1, 2)}")))}[kind]
            semantic = tag != "div" and draw.random() < 0.65 and kind != "comments"
            use = tag if semantic else draw.choice(("div", "div", "section")) if kind != "form" else draw.choice(("form", "div"))
            # only what a tag, a name or its links give away can be told from the article
            named = attr(kind, 0.4 if semantic or use == "form" or kind in ("nav", "share") else 1.0)
            return f"<{use}{named}>{own}</{use}>"

        top = [bad(k) for k in draw.sample(("nav", "header", "notice", "ad", "form", "pages", "nav", "share"), draw.randint(0, 4))]
        end = [bad(k) for k in draw.sample(("footer", "aside", "comments", "share", "ad", "pages", "form", "notice", "footer", "comments"), draw.randint(1, 6))]
        title = f"<h1>{good(phrase(2, 10))}</h1>" if draw.random() < 0.8 else ""
        inside = title + body()
        if draw.random() < 0.3:
            inside += bad(draw.choice(("share", "comments", "aside", "ad", "pages", "form")))
        shell = draw.random()
        if shell < 0.4:
            inside = f"<article{attr('content', 0.3)}>{inside}</article>"
        elif shell < 0.55:
            inside = f"<main{attr('content', 0.3)}>{inside}</main>"
        elif shell < 0.9:
            inside = f"<div{attr('content', 0.7)}>{inside}</div>"
        page = "".join(top) + inside + "".join(end)
        if draw.random() < 0.4:
            page = f'<div{draw.choice((" id=wrapper", " class=container", " class=page", ""))}>{page}</div>'
        yield f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title></head><body>{page}" + draw.choice(("</body></html>", "")), main


def train(pages: int = 500, seed: int = 11) -> Extractor:
    """An extractor fitted on generated pages; token odds come from the same pages (a token's share of kept nodes)."""
    parsed = []
    for html, main in training_pages(pages, seed):
        page = Page(html)
        blocks = page.blocks()
        n = len(page.tags)
        kept, total = [0] * n, [0] * n
        for owner, text, _ in blocks:
            total[owner] += 1
            kept[owner] += text in main
        for i in range(n - 1, 0, -1):
            kept[page.parents[i]] += kept[i]
            total[page.parents[i]] += total[i]
        parsed.append((page, blocks, np.array(kept), np.array(total)))
    tally: dict[str, list[float]] = {}
    for page, _, kept, total in parsed:
        for i, tokens in enumerate(page.tokens):
            if total[i]:
                for w in tokens:
                    one = tally.setdefault(w, [0.0, 0.0])
                    one[0] += kept[i] / total[i]
                    one[1] += 1
    odds = {w: float(np.log((a + 0.5) / (b - a + 0.5))) for w, (a, b) in tally.items()}
    rows, labels = [], []
    for page, blocks, kept, total in parsed:
        pure = (total > 0) & ((kept == 0) | (kept == total))
        rows.append(features(page, blocks, odds)[pure])
        labels.append((kept > 0)[pure])
    return Extractor(odds, Trees().fit(np.concatenate(rows), np.concatenate(labels).astype(float)))


def extract(pages: DataFrame, extractor: Extractor, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of each whole page; null and empty pages have an empty one.

    Other columns stay; an old one called ``text`` is replaced. One narrow pass, nothing is shuffled.
    """
    spark = ready(pages.sparkSession)
    rest = [c for c in pages.columns if c != text]
    at = rest.index(html)
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields)) + ", found string"
    model = spark.sparkContext.broadcast(extractor)  # of fixed size: token odds and trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.value.texts([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "found"])

    return plain.mapInArrow(run, schema).toDF(*rest, text)
