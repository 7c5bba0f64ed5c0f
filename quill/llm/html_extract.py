"""Main text of web pages by wrapper induction.

A page becomes a tree of blocks with their text. Of each host two pivot pages are aligned with
all the host's pages by simple tree matching, over the whole of both trees; a pivot's text
node that at least SHARE of the host's different pages have unchanged at the aligned place, and
MIN_PAGES pages at least, is template. What a page has at the place of a template node,
unchanged, is left out; what varies from page to page is content.

Slots that vary are not always content: menus, adverts and comments vary too. So elements that
say what they are by tag, role or an unmistakable class word go as well. Other class words are
votes: outside of articles they count unless most of the text stands there; inside of one they
count only if alignment confirms them, that is if SHARE of the host's pages have an article
with an element of that tag and word. If articles (else main elements) hold half of what
is left, the text is taken from there.

A page is parsed and aligned once; its texts are written with the numbers of the pivots' nodes
that they repeat. Counts of these by host are pre-aggregated, and a second pass over the written
texts leaves out what the counts call template. Pivots and templates join pages by host through
a broadcast while measured to be small, by a shuffle that Spark can split beyond it. Neither
the size of a page nor its depth or the number of its blocks changes how it is read.
"""

from __future__ import annotations

import html as html_
import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, map_arrow, side

SHARE, MIN_PAGES = 0.5, 3
#: Pages up to this size are pivots rather than larger ones of their host.
PIVOT_BYTES = 1 << 17
#: Cells of an alignment that are held at once; a larger one is halved (and gives the same).
CELLS = 1 << 22

# Element names of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "audio", "video", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
#: Inline elements whose text is none of the page's.
DROPPED_INLINE = {"button", "select", "option", "label", "annotation", "annotation-xml"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "search", "complementary", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
#: Class words that are no main text anywhere: adverts and what readers say.
STRONG = re.compile(
    r"(?:(?:reader|user|page|post|article|google)s?[_-])?(?:ads?|adverts?|advertis(?:ing|ements?)|adsense|sponsor(?:ed|s)?|promos?|comments?|commentlist|disqus|repl(?:y|ies)|respond)"
    r"(?:[_-](?:\d+|area|banner|block|box|container|form|list|section|slot|thread|unit|wrap|wrapper))?",
    re.I,
)
#: The same for an article, which may be a teaser of another page.
NO_ARTICLE = re.compile(r"(?:.*[_-])?(?:related|teaser|card|promo)s?(?:[_-].*)?", re.I)
#: Whole class words of menus and notices; and words, whole or as a part, that are votes.
MENUS = {
    "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pager", "pagination", "popup", "signup", "subscribe", "toolbar", "topbar",
}
VOTES = re.compile(
    r"(?:^|[_-])(?:ads?|advert(?:s|isement|ising)?|adsense|banner|sponsor(?:ed|s)?|promo(?:s|tion)?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"nav|navbar|navigation|menu|sidebar|side|rail|footer|header|masthead|topbar|breadcrumbs?|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommended|widgets?|toolbar|pagination|pager|tags?|search)(?:$|[_-]|\d)",
    re.I,
)
#: Beginnings of words that tell of a layout with such parts.
LAYOUT = re.compile(r"(?:no|with|has|without|is|show|hide)[_-]", re.I)
#: Open elements that a start tag ends: its own kind in lists and tables, paragraphs by any block.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "nav", "body", "td", "th"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']+|"[^"<]*"|'[^'<]*'|["'])*+)>""", re.S)
#: The same for what follows a tag that never ends: a tag has to end before the next begins.
_SHORT = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?>[^<>"']+|"[^"<]*"|'[^'<]*'|["'])*+)>""", re.S)
_BEGINS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

#: Elements that may stand around a whole page, and what is left of a page's beginning where a menu's end tag is missing.
WRAPPERS, LISTS = {"form", "fieldset"}, {"#", "ul", "ol", "menu", "dl"}
#: Words of STRONG that an article's own parts may bear.
ANSWERS = re.compile(r"(?:[a-z]+[_-])?(?:repl(?:y|ies)|respond)(?:[_-].*)?", re.I)

#: What an element says of itself: no main text for sure (head, inline, hidden), by tag or role, by a STRONG word, by one of MENUS, by a vote; a slot is a vote inside an article.
SURE, KIND, READER, MENU, VOTE, SLOT = 6, 5, 4, 3, 2, 1


class Node:
    """A block, or a text (tag #). shape: a hash of the tags below, n: how many nodes they are; first, last: its texts among the page's."""

    __slots__ = ("tag", "kids", "text", "mark", "slot", "shape", "n", "first", "last", "wraps")

    def __init__(self, tag: str, text: str = ""):
        self.tag, self.kids, self.text, self.mark, self.slot, self.shape, self.n, self.first, self.last = tag, [], text, 0, 0, 0, 1, 0, 0
        self.wraps = tag in WRAPPERS  # may stand around what it doesn't name; so may whatever has no end tag


def _says(tag: str, attributes: str, inside: bool) -> tuple[int, int]:
    """The mark of an element, and the code of its slot (negative) if it is a vote inside an article. A header inside an article is the article's."""
    if tag == "head" or tag in DROPPED_INLINE:
        return SURE, 0
    mark, slot = KIND if tag in DROPPED or tag == "header" and not inside else 0, 0
    if attributes and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return SURE, 0
            if name == "role" and value.strip().lower() in ROLES:
                mark = KIND
            if name not in ("class", "id") or tag in HEADINGS:
                continue
            for word in value.lower().split():
                if LAYOUT.match(word):
                    continue
                if STRONG.fullmatch(word) and not (inside and ANSWERS.fullmatch(word)) or tag == "article" and NO_ARTICLE.fullmatch(word):
                    mark = max(mark, READER)
                elif tag in ("article", "main"):
                    continue
                elif inside:
                    if VOTES.search(word) and (VOTES.fullmatch(word) or STRONG.fullmatch(word)) and not mark:
                        mark, slot = SLOT, -2 - (zlib.crc32(f"{tag} {word}".encode()) & 0x3FFFFFFF)
                elif word in MENUS:
                    mark = max(mark, MENU)
                elif VOTES.search(word):
                    mark = max(mark, VOTE)
    return mark, slot if mark == SLOT else 0


def parse(page: str) -> Node:
    """The tree of blocks; text nodes (#) hold the inline text of a block between its child blocks, white space collapsed."""
    root = Node("#root")
    stack, open_ = [root], {}  # open block elements, and how many of each tag
    parts: list[str] = []
    inside, inline_drop = 0, []
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(html_.unescape("".join(parts)).split())
            parts.clear()
            if text:
                stack[-1].kids.append(Node("#", text))

    def pop(to: int, ended: bool = False) -> None:
        nonlocal inside
        flush()
        while len(stack) > to:
            gone = stack.pop()
            gone.wraps |= not (ended and len(stack) == to)
            open_[gone.tag] -= 1
            inside -= gone.tag in ("article", "main")

    token, last = _TOKEN, max(map(page.rfind, (">", "<!", "<?")))
    while at < n:
        start = page.find("<", at)
        if start > last:
            start = -1  # no tag can end any more
        m = token.match(page, start) if start >= 0 else None
        if start >= 0 and m is None and token is _TOKEN and _BEGINS.match(page, start):
            token = _SHORT  # a tag that reaches the page's end: none is looked for so far again
            m = token.match(page, start)
        text = page[at:start] if m else page[at : start + 1] if start >= 0 else page[at:]
        if text and not inline_drop:
            parts.append(text)
        if not m:
            if start < 0:
                break
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            inline_drop = []
            if closing:
                if open_.get(tag):
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    pop(k, ended=True)
                else:
                    flush()
                continue
            flush()
            if stack[-1].tag == "p":
                pop(len(stack) - 1)
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS[tag]:
                        pop(k)
                    elif stack[k].tag in SCOPE - ENDS[tag]:
                        break
            node = Node(tag)
            node.mark, node.slot = _says(tag, attributes, inside > 0)
            node.wraps |= node.mark == KIND and tag not in DROPPED and "form" in attributes.lower()
            stack[-1].kids.append(node)
            if tag not in VOID:
                stack.append(node)
                open_[tag] = open_.get(tag, 0) + 1
                inside += tag in ("article", "main")
            continue
        if tag in VOID:
            parts.append(" ")
        if inline_drop:
            if closing and tag == inline_drop[-1]:
                inline_drop.pop()
            elif not closing and tag == inline_drop[-1] and tag not in VOID:
                inline_drop.append(tag)
        elif not closing and tag not in VOID and not attributes.endswith("/") and (tag in DROPPED_INLINE or attributes and _says(tag, attributes, True)[0] >= READER):
            inline_drop.append(tag)
    pop(1)
    flush()
    return root


@dataclass
class Page:
    """A parsed page: its tree, its texts in page order, which of them are main text as far as the page itself tells, and their slots."""

    tree: Node
    texts: list[str]
    kept: list[bool]
    slots: list[tuple[int, ...]]


def _sizes(nodes: list[Node], parents: list[int], most: int = READER - 1) -> tuple[list[int], list[int]]:
    """Characters below each node, and those in articles and mains, but for elements that are marked by more than most; with READER, for those that are READER or SURE."""
    total, within = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        total[i] += len(node.text)
        if i and (node.mark <= most or most == READER and node.mark == KIND) and not (most == READER and node.mark == READER):
            total[parents[i]] += total[i]
            within[parents[i]] += total[i] if node.tag in ("article", "main") and node.mark in (0, KIND) else within[i]
    return total, within


def read(html: str) -> Page:
    """Parse a page and judge its texts by what elements say of themselves."""
    root = parse(html)
    nodes, parents, texts = [], [], []
    todo = [(root, -1)]
    while todo:
        node, parent = todo.pop()
        at = len(nodes)
        nodes.append(node)
        parents.append(parent)
        node.first = len(texts)
        if node.tag == "#":
            texts.append(node)
        todo.extend((k, at) for k in reversed(node.kids))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node.last = node.first + 1 if node.tag == "#" else max((k.last for k in node.kids), default=node.first)
        node.shape = xxhash.xxh64_intdigest(np.array([k.shape for k in node.kids], dtype=np.uint64).tobytes() + node.tag.encode())
        node.n = 1 + sum(k.n for k in node.kids)
    total, within = _sizes(nodes, parents)
    # What goes by tag or role stays if it holds the articles, and little stands outside unless it may wrap a page; or if it may, and holds most of the text.
    if any(node.mark == KIND for node in nodes):
        inner, articles = _sizes(nodes, parents, READER)[1], 0
        for node, size, parent in zip(nodes, inner, parents, strict=True):
            articles += size if parent == 0 else 0
        outside = total[0]
        for i, node in enumerate(nodes):
            if node.mark == KIND and (2 * inner[i] >= articles > 0 and (node.wraps or inner[i] > 8 * outside) or node.wraps and total[i] > outside):
                node.mark = 0
                for kid in node.kids if node.tag not in WRAPPERS else ():
                    if kid.tag not in LISTS:
                        break
                    kid.mark = SURE
        total, within = _sizes(nodes, parents)
    # A page that is made of nothing but READER elements is judged as if those were votes.
    bare = not total[0]
    gone, slots = [False] * len(nodes), [()] * len(nodes)
    area = {"article": [], "main": []}
    left = {"article": 0, "main": 0, "#": 0}  # characters left in articles, in mains, and in all
    for i, (node, parent) in enumerate(zip(nodes, parents, strict=True)):
        if parent >= 0:
            gone[i], slots[i] = gone[parent], slots[parent]
        holds = 2 * within[i] >= within[0] > 0
        most = 2 * total[i] > total[0]
        if node.mark >= KIND or node.mark == READER and not bare or node.mark == MENU and not holds or node.mark == VOTE and not (holds or most):
            gone[i] = True
        elif node.mark == SLOT:
            slots[i] = (*slots[i], node.slot)
        if node.tag == "#" and not gone[i]:
            left["#"] += len(node.text)
    kept = [False] * len(texts)
    live = [False] * len(texts)
    for i, node in enumerate(nodes):
        if node.tag == "#":
            live[node.first] = not gone[i]
    for i, node in enumerate(nodes):
        if node.tag in area and not gone[i] and not any(a.first <= node.first and node.last <= a.last for a in area[node.tag][-1:]):
            size = sum(len(texts[k].text) for k in range(node.first, node.last) if live[k])
            if size:
                area[node.tag].append(node)
                left[node.tag] += size
    in_main = sum(len(texts[k].text) for a in area["article"] for k in range(a.first, a.last) if live[k] and any(m.first <= a.first and a.last <= m.last for m in area["main"]))
    if left["article"] and 2 * left["article"] >= (left["main"] or left["#"]) and 2 * in_main < left["article"]:
        where = area["article"]
    else:
        where = area["main"] if left["main"] else [root]
    for node in where:
        for k in range(node.first, node.last):
            kept[k] = live[k]
    text_slots = [slots[i] for i, node in enumerate(nodes) if node.tag == "#"]
    return Page(root, [t.text for t in texts], kept, text_slots)


class Matcher:
    """Simple tree matching: the largest number of nodes of two trees that can be paired, tag by tag, in order and below paired parents.

    Two nodes of one shape are paired throughout, and each text that is equal at its place
    counts a half more; the number for two shapes does not depend on texts, and is kept.
    """

    KEPT = 1 << 16

    def __init__(self):
        self.known: dict[tuple[int, int], float] = {}

    def structure(self, a: Node, b: Node) -> float:
        """Nodes that can be paired, for two nodes of one tag."""
        if a.shape == b.shape:
            return float(a.n)
        key = (a.shape, b.shape)
        if (found := self.known.get(key)) is None:
            found = 1.0 + (self._align(a.kids, b.kids, None, None)[0] if a.kids and b.kids else 0.0)
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[key] = found
        return found

    def pairs(self, a: Node, b: Node, x: list[str], y: list[str]) -> list[tuple[int, int]]:
        """Numbers of the texts that are paired when a and b are."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if a.shape == b.shape:
                out.extend(zip(range(a.first, a.last), range(b.first, b.last), strict=True))
            elif a.kids and b.kids:
                todo.extend((a.kids[i], b.kids[j]) for i, j in self._align(a.kids, b.kids, x, y)[1])
        return out

    def _align(self, xs: list[Node], ys: list[Node], x: list[str] | None, y: list[str] | None) -> tuple[float, list[tuple[int, int]]]:
        """The best alignment of two lists of siblings: its weight and, with texts, its pairs."""
        same = lambda a, b: a.shape == b.shape and (x is None or x[a.first : a.last] == y[b.first : b.last])
        weight = lambda a: a.n + (0.5 * (a.last - a.first) if x is not None else 0.0)
        # Equal siblings at either end are paired in some best alignment.
        total, pairs, start, n, m = 0.0, [], 0, len(xs), len(ys)
        while start < min(n, m) and same(xs[start], ys[start]):
            total += weight(xs[start])
            pairs.append((start, start))
            start += 1
        while min(n, m) > start and same(xs[n - 1], ys[m - 1]):
            n, m = n - 1, m - 1
            total += weight(xs[n])
            pairs.append((n, m))
        if start < n and start < m:
            rows = _Rows(self, xs[start:n], ys[start:m], x, y)
            total += rows.best(range(n - start), range(m - start))[-1]
            if x is not None:
                pairs.extend((start + i, start + j) for i, j in rows.pairs(0, n - start, 0, m - start))
        return total, pairs


class _Rows:
    """The weights of pairing siblings, a row for each of xs."""

    def __init__(self, matcher: Matcher, xs: list[Node], ys: list[Node], x: list[str] | None, y: list[str] | None):
        self.matcher, self.xs, self.ys, self.x, self.m = matcher, xs, ys, x, len(ys)
        by_shape: dict[int, list[int]] = {}
        for j, b in enumerate(ys):
            by_shape.setdefault(b.shape, []).append(j)
        self.groups = {s: np.array(js) for s, js in by_shape.items()}
        if x is not None:
            self.texts = {s: np.array([[hash(t) for t in y[ys[j].first : ys[j].last]] for j in js], dtype=np.int64) for s, js in by_shape.items()}
        self.plain: dict[int, np.ndarray] = {}

    def row(self, i: int) -> np.ndarray:
        a = self.xs[i]
        if (plain := self.plain.get(a.shape)) is None:
            plain = np.zeros(self.m)
            for js in self.groups.values():
                if self.ys[js[0]].tag == a.tag:
                    plain[js] = self.matcher.structure(a, self.ys[js[0]])
            self.plain[a.shape] = plain
        if self.x is None or a.shape not in self.groups or a.first == a.last:
            return plain
        out = plain.copy()
        own = np.array([hash(t) for t in self.x[a.first : a.last]], dtype=np.int64)
        out[self.groups[a.shape]] += 0.5 * (self.texts[a.shape] == own).sum(axis=1)
        return out

    def best(self, is_: range, js: range, back: bool = False, table: np.ndarray | None = None) -> np.ndarray:
        """The best weights of aligning is_ with each beginning (back: each end) of js; table gets all rows."""
        last = np.zeros(len(js) + 1)
        for k, i in enumerate(reversed(is_) if back else is_, 1):
            row = self.row(i)[js.start : js.stop]
            row = row[::-1] if back else row
            new = last.copy()
            np.maximum(last[1:], last[:-1] + row, out=new[1:])
            last = np.maximum.accumulate(new, out=new)
            if table is not None:
                table[k] = last
        return last

    def pairs(self, a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
        """The pairs of a best alignment of xs[a:b] with ys[c:d]."""
        if a >= b or c >= d:
            return []
        if (b - a) * (d - c) > CELLS and b - a > 1:
            middle = (a + b) // 2
            cut = c + int(np.argmax(self.best(range(a, middle), range(c, d)) + self.best(range(middle, b), range(c, d), back=True)[::-1]))
            return self.pairs(a, middle, c, cut) + self.pairs(middle, b, cut, d)
        table = np.zeros((b - a + 1, d - c + 1))
        self.best(range(a, b), range(c, d), table=table)
        out, i, j = [], b - a, d - c
        while i and j:
            if table[i, j] == table[i - 1, j]:
                i -= 1
            elif table[i, j] == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
        return out[::-1]


def unchanged(matcher: Matcher, pivot: Page, page: Page) -> list[tuple[int, int]]:
    """(number of the pivot's text, number of the page's) where the page has it unchanged at the aligned place."""
    return [(i, j) for i, j in matcher.pairs(pivot.tree, page.tree, pivot.texts, page.texts) if pivot.texts[i] == page.texts[j]]


def main_text(page: Page, template: set[int] | frozenset = frozenset()) -> str:
    """The page's main text, a block a paragraph, without the texts (by number) in template."""
    return "\n\n".join(t for i, (t, k) in enumerate(zip(page.texts, page.kept, strict=True)) if k and i not in template)


def _host(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def extract(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: the id, url, text, n_chars, and n_blocks, n_marked, n_template.

    n_blocks counts all the page's texts, n_marked those that go for what elements say of
    themselves, n_template those that the host's template has at that place (marked or not) and
    confirmed slots. Null and empty pages have an empty text, and so have pages of which all is
    template or marked. Pages without a host (null urls among them) are no one's template. Rows
    that repeat are each extracted, but count once in a host's counts; pivots of one hash are
    equal pages, so ties don't matter. Other columns are not carried, whatever they are called.
    """
    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), _host(url_col).alias("host")).withColumn("hx", F.xxhash64("html"))
    whole = rows.where((F.col("host") != "") & (F.col("html") != ""))
    # A host's pivots: the first pages by two hashes, of the small ones if there are any. Only hashes travel until hosts
    # that are too small for a template are left out.
    sizes = whole.select("host", "hx", (F.octet_length("html") > PIVOT_BYTES).alias("large")).distinct()
    chosen = sizes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min_by("hx", F.struct("large", "hx")).alias("h0"), F.min_by("hx", F.struct("large", F.bitwise_not("hx"))).alias("h1")).where(F.col("n") >= min_pages)
    wanted = chosen.select("host", F.explode(F.array_distinct(F.array("h0", "h1"))).alias("hx"))
    pages_of = whole.select("host", "hx", "html").join(side(wanted), ["host", "hx"]).groupBy("host", "hx").agg(F.min("html").alias("html"))
    pivots = chosen.join(pages_of, "host").groupBy("host").agg(F.min(F.when(F.col("hx") == F.col("h0"), F.col("html"))).alias("p0"), F.min(F.when(F.col("hx") == F.col("h1"), F.col("html"))).alias("p1"))
    known: dict = {}
    matcher = Matcher()

    def compare(batch):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 20))  # pages may be as deep as they are long
        out = {"texts": [], "codes": []}  # a marked text is null, and has its codes still
        for page, p0, p1 in zip(*(batch.column(c).to_pylist() for c in ("html", "p0", "p1")), strict=True):
            own = read(page)
            codes: list[list[int]] = [list(s) for s in own.slots]
            if p0 is not None:
                if (p0, p1) not in known:
                    if len(known) > 64:
                        known.clear()
                    known[p0, p1] = [read(p) for p in dict.fromkeys((p0, p1))]
                for k, pivot in enumerate(known[p0, p1]):
                    for i, j in unchanged(matcher, pivot, own):
                        codes[j].append(k << 40 | i)
            out["texts"].append([t if kept else None for t, kept in zip(own.texts, own.kept, strict=True)])
            out["codes"].append(codes)
        yield {c: batch.column(c) for c in ("id", "url", "host", "hx")} | out

    joined = rows.join(side(pivots), "host", "left").select("id", "url", "host", "hx", "html", "p0", "p1")
    read_ = map_arrow(joined, compare, f"id {kind}, url string, host string, hx long, texts array<string>, codes array<array<long>>")
    read_ = checkpoint(read_)
    seen = read_.where("host <> ''").groupBy("host", "hx").agg(F.min(F.array_distinct(F.flatten("codes"))).alias("same"))  # equal pages count once
    # -1 stands for the page itself, so that one count has the host's pages too.
    counts = seen.select("host", F.explode(F.concat(F.array(F.lit(-1).cast("long")), "same")).alias("code")).groupBy("host", "code").agg(F.count(F.lit(1)).alias("n"))
    table = counts.groupBy("host").agg(F.max(F.when(F.col("code") == -1, F.col("n"))).alias("pages"), F.collect_list(F.when((F.col("code") != -1) & (F.col("n") >= min_pages), F.struct("code", "n"))).alias("often"))
    template = table.select("host", F.transform(F.filter("often", lambda x: x["n"] >= share * F.col("pages")), lambda x: x["code"]).alias("constant"))

    def take(batch):
        out = {"text": [], "n_chars": [], "n_blocks": [], "n_marked": [], "n_template": []}
        for texts, codes, constant in zip(*(batch.column(c).to_pylist() for c in ("texts", "codes", "constant")), strict=True):
            fixed = set(constant or ())
            free = [fixed.isdisjoint(c) for c in codes]
            text = "\n\n".join(t for t, ok in zip(texts, free, strict=True) if ok and t is not None)
            for c, v in (("text", text), ("n_chars", len(text)), ("n_blocks", len(texts)), ("n_marked", texts.count(None)), ("n_template", free.count(False))):
                out[c].append(v)
        yield {c: batch.column(c) for c in ("id", "url")} | out

    done = map_arrow(read_.join(side(template), "host", "left").select("id", "url", "texts", "codes", "constant"), take, f"id {kind}, url string, text string, n_chars long, n_blocks int, n_marked int, n_template int")
    return done.withColumnsRenamed({"id": id_col, "url": url_col})
