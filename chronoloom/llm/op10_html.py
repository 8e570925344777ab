"""Main text of web pages by composite text density.

A page is parsed to a tree that tolerates unclosed tags. Each node's density is its characters per tag, adjusted by
its share of link characters and link tags and by the page's own link ratio (the composite text density of Sun, Song
and Liao, 2011). The least density on the path from the body to the node whose children's densities have the largest
sum is the threshold. Every node that reaches it, or the density of the sparsest block of text in that densest node, by its
density or its children's sum marks the node of largest sum below itself, and the main text is the least subtree with
all that is marked, without link-heavy parts below the threshold. Only then do tags count: where the densest node stands in an
article or main element, what is marked is taken within such elements (one subtree in each outermost one, grown to the
whole element); else the subtree grows by headings beside it.
Elements that by name, role or class are menus, headers, footers, sidebars, notices, adverts, forms or comments take no part,
unless they hold the page's largest article or main element, longer than all text that is left without it, or, where no such
element is free, most of the page's text outside links.
A class counts as a whole: has-sidebar is no sidebar, but a cookie-banner is made of such names alone.

Defined cases: null or empty html gives the empty text; a page without tags is one block; unclosed comments, scripts and styles
end with the page, other raw elements without an end tag hold nothing (a title: the text up to the next tag), and svg and math end where
a page's own element begins; time and memory are linear in a page's length, whatever its tags; rows with equal ids are separate; an empty table gives an empty result; whole pages are parsed, whatever their length.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content is no text of the page, parsed like others.
APART = frozenset("noscript template svg math".split())
#: Besides blocks, the start tags that end an open svg or math element.
BREAKS = frozenset("b big br code em i img s small span strong strike sub sup tt u var".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the value, unless one of the fences stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCES = frozenset("ul ol dl table select body html article section div main".split())
CLOSE_P = BLOCK - {"body", "html", "option", "optgroup", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption"}
AWAY_TAGS = frozenset("nav header footer aside form button select menu dialog".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted related reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Elements that hold controls or data and never a page's main text.
NEVER = frozenset("head select button svg math noscript template".split())
#: Elements that are something else than the main text even where they hold most of a page's text.
ASIDE = frozenset("nav footer aside menu dialog".split())
#: Elements that a page's main text may stand in even if their class has one of the names.
KEEP_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = BLOCK - HEADINGS - {"p", "pre"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRS = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(token: str) -> bool:
    """Is a class made of the names alone? Other pieces say more of an element than that it is one of them."""
    names = [x for x in re.split(r"[^a-z]+", token) if x]
    return bool(names) and AWAY_NAMES.issuperset(names)


def away(tag: str, attrs: str) -> bool:
    """Is the element no part of a main text by its name, role, class or id?"""
    if tag in AWAY_TAGS:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in AWAY_ROLES):
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
        if name in ("class", "id") and tag not in KEEP_TAGS and any(_named(x) for x in value.split()):
            return True
    return False


class Tree:
    """Nodes in page order: tag, parent, whether it is left out, and the pieces of text with their nodes."""

    def __init__(self, page: str):
        self.tag, self.parent, self.out = ["html"], [-1], [False]
        self.texts: list[tuple[int, str | None]] = []  # None: a block begins or ends
        self.open_, self.places, self.blocks = [0], {"html": [0]}, []  # open nodes; places of tags and of blocks among them
        self.page, self.endless, self.loose = page, set(), False
        at, n = 0, len(page)
        while at < n:
            begin = page.find("<", at)
            kind, name, attrs, end = self._markup(begin) if begin >= 0 else ("", "", "", n)
            while kind == "text":  # a "<" that begins no tag
                begin = page.find("<", begin + 1)
                kind, name, attrs, end = self._markup(begin) if begin >= 0 else ("", "", "", n)
            upto = begin if begin >= 0 else n
            if upto > at:
                self.texts.append((self.open_[-1], page[at:upto]))
            at = end
            if kind == "start":
                at = self._start(name, attrs, at)
            elif kind == "end":
                self._close(name)
        if any(self.out):
            self._leave_out()

    def _markup(self, at: int) -> tuple[str, str, str, int]:
        """What begins at the "<" at `at`: its kind, name, attributes and where it ends."""
        page, n = self.page, len(self.page)
        if page.startswith("<!--", at):
            m = _COMMENT_END.search(page, at + 4)
            return "", "", "", m.end() if m else n
        c = page[at + 1 : at + 2]
        if c in ("!", "?", "/"):
            m = _NAME.match(page, at + 2) if c == "/" else None
            stop = page.find(">", m.end() if m else at + 2)
            return ("end" if m else "", m[0].lower() if m else "", "", stop + 1) if stop >= 0 else ("", "", "", n)
        m = _NAME.match(page, at + 1)
        if not m:
            return "text", "", "", at + 1
        begin = m.end()
        if not self.loose:
            stop = _ATTRS.match(page, begin).end()
            if stop < n and page[stop] == ">":
                return "start", m[0].lower(), page[begin:stop], stop + 1
            self.loose = stop >= n  # quotes up to the page's end hide every ">": from here on they are not believed
        stop = page.find(">", begin)
        return ("start", m[0].lower(), page[begin:stop], stop + 1) if stop >= 0 else ("", "", "", n)

    def _has_end(self, tag: str, at: int) -> re.Match | None:
        """The end tag of a raw element; that there is no further one is looked up once."""
        if tag in self.endless:
            return None
        m = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>", re.I).search(self.page, at)
        if not m:
            self.endless.add(tag)
        return m

    def _start(self, tag: str, attrs: str, at: int) -> int:
        """Open an element; where the parser goes on."""
        if tag in RAW:
            m = self._has_end(tag, at)
            if m:
                return m.end()
            if tag in ("script", "style"):
                return len(self.page)
            more = self.page.find("<", at) if tag in ("title", "textarea") else at
            return more if more >= 0 else len(self.page)
        if tag == "html":
            return at
        if tag in BLOCK or tag in BREAKS:
            for foreign in ("svg", "math"):
                if self.places.get(foreign):
                    self._pop(self.places[foreign][0])
        self._make_room(tag)
        if tag in ("noscript", "template") and not self._has_end(tag, at):
            return at
        self.tag.append(tag)
        self.parent.append(self.open_[-1])
        self.out.append(tag == "head" or tag in APART or away(tag, attrs))
        if tag in BLOCK or tag == "br":
            self.texts.append((self.open_[-1], " " if tag == "br" else None))
        if tag not in VOID and not attrs.endswith("/"):
            self.places.setdefault(tag, []).append(len(self.open_))
            if tag in BLOCK:
                self.blocks.append(len(self.open_))
            self.open_.append(len(self.tag) - 1)
        return at

    def _pop(self, k: int) -> None:
        """Close the open nodes from place k on."""
        for i in self.open_[k:]:
            self.places[self.tag[i]].pop()
        del self.open_[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _leave_out(self) -> None:
        """Pass on what is left out to all below, but for elements that hold the page's main text."""
        n = len(self.tag)
        chars, link = [0] * n, [False] * n
        for i in range(1, n):
            link[i] = self.tag[i] == "a" or link[self.parent[i]]
        for i, t in self.texts:
            if t and not link[i]:
                chars[i] += len(_SPACE.sub(" ", t).strip())
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        mains = [i for i in range(1, n) if self.tag[i] in ("article", "main") and not self.out[i] and chars[i]]
        main = max(mains, key=lambda i: chars[i], default=0)
        below = self._below()
        if all(below[i] for i in mains):  # no article or main is free
            for i in range(1, n):
                if 2 * chars[i] > chars[0] and self.tag[i] not in NEVER | ASIDE:
                    self.out[i] = False
            below = self._below()
        if below[main]:
            free = chars[0] - sum(chars[i] for i in range(1, n) if below[i] and not below[self.parent[i]])
            i = self.parent[main] if chars[main] > free else 0
            while i > 0:
                self.out[i] = self.out[i] and self.tag[i] in NEVER
                i = self.parent[i]
            below = self._below()
        self.out = below

    def _below(self) -> list[bool]:
        """Is the node or one above it left out?"""
        below = list(self.out)
        for i in range(1, len(below)):
            below[i] = below[i] or below[self.parent[i]]
        return below

    def body(self) -> int:
        return next((i for i, t in enumerate(self.tag) if t == "body"), 0)

    def _make_room(self, tag: str) -> None:
        if self.places.get("head") and (tag == "body" or (tag in BLOCK and self.tag[self.open_[-1]] == "head")):
            self._pop(self.places["head"][0])
        if tag in CLOSE_P and self.places.get("p") and self.places["p"][-1] == self.blocks[-1]:
            self._pop(self.blocks[-1])
        closes = CLOSES.get(tag)
        while closes:
            k = self._last(closes)
            if k <= self._last(FENCES - closes):
                break
            self._pop(k)
            if tag not in ("tr", "tbody", "tfoot"):
                break

    def _close(self, tag: str) -> None:
        if tag == "html" or not self.places.get(tag):
            return
        k = self.places[tag][-1]
        within = self.blocks[-1] if self.blocks else 0
        if tag not in BLOCK and within > k:
            return
        if within >= k:
            self.texts.append((self.open_[k], None))
        self._pop(k)


def densities(tree: Tree) -> tuple[list[float], list[float], list[list[int]]]:
    """Composite density of every node, the sum of its children's, and characters, tags, link characters, link tags.

    The base of the logarithm is moved up by e - 1, so that it is never 1 on pages without links.
    """
    n = len(tree.tag)
    chars, tags, lchars, ltags, link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(n):
        link[i] = tree.tag[i] == "a" or (i > 0 and link[tree.parent[i]])
        if i and not tree.out[i]:
            tags[tree.parent[i]] += 1
            ltags[tree.parent[i]] += link[i]
    for i, t in tree.texts:
        if t and not tree.out[i]:
            k = len(_SPACE.sub(" ", t).strip())
            chars[i] += k
            lchars[i] += k * link[i]
    for i in range(n - 1, 0, -1):
        if not tree.out[i]:
            for v in (chars, tags, lchars, ltags):
                v[tree.parent[i]] += v[i]
    body = tree.body()
    ratio = lchars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, tags[i]), lchars[i], max(1, ltags[i])
        if c and not tree.out[i]:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e) + math.e - 1
            density[i] = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)
        if i:
            sums[tree.parent[i]] += density[i]
    return density, sums, [chars, tags, lchars, ltags]


def main_subtrees(tree: Tree, density: list[float], sums: list[float], chars: list[int], lchars: list[int]) -> tuple[set[int], float]:
    """The roots of the main text, and the least density on the path from the body to its densest part."""
    n, body = len(tree.tag), tree.body()
    top = [0] * n  # the outermost article or main element around a node, if it has text
    for i in range(1, n):
        top[i] = top[tree.parent[i]] or (i if tree.tag[i] in ("article", "main") and not tree.out[i] and chars[i] else 0)
    open_ = [i for i in range(n) if not tree.out[i] and chars[i]]
    if not open_:
        return {body}, math.inf
    rank = lambda i: (sums[i], chars[i], -i)
    # a paragraph or heading is text, not a container of it, whatever markup it has inside
    best = max([i for i in open_ if tree.tag[i] in CONTAINERS] or open_, key=rank)
    least, i = density[best], best
    while i not in (0, body):
        i = tree.parent[i]
        least = min(least, density[i])
    some = top[best] > 0
    if some:
        open_ = [i for i in open_ if top[i]]
    else:
        top = [0] * n
    densest = list(range(n))  # of each node, the node of largest sum in its subtree
    for i in reversed(open_):
        p = tree.parent[i]
        if p >= 0 and rank(densest[i]) > rank(densest[p]):
            densest[p] = densest[i]
    sparse = min([least, *(density[i] for i in open_ if tree.parent[i] == best and tree.tag[i] in BLOCK and density[i] and 2 * lchars[i] <= chars[i])])
    marks = {best} | {densest[i] for i in open_ if max(density[i], sums[i]) >= sparse}
    below, total, roots = [0] * n, {}, {}
    for i in range(n - 1, -1, -1):
        below[i] += i in marks
        if i:
            below[tree.parent[i]] += below[i]
    for i in marks:
        total[top[i]] = total.get(top[i], 0) + 1
    for i in open_:  # the last with all marks is the lowest
        if below[i] == total.get(top[i]):
            roots[top[i]] = i
    if some:
        near = [0] * n  # the innermost article or main element around a node: a heading beside the densest part belongs to it
        for i in range(1, n):
            near[i] = i if tree.tag[i] in ("article", "main") else near[tree.parent[i]]
        return {near[i] or i for i in roots.values()}, least
    kids: dict[int, list[int]] = {}
    for i in open_:
        kids.setdefault(tree.parent[i], []).append(i)
    i = roots[0]
    while i not in (0, body):
        p = tree.parent[i]
        if chars[p] > sum(chars[j] for j in kids[p]) or not all(j == i or (tree.tag[j] in HEADINGS and 2 * lchars[j] <= chars[j]) for j in kids[p]):
            break
        i = p
    return {i}, least


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    density, sums, (chars, _, lchars, ltags) = densities(tree)
    roots, least = main_subtrees(tree, density, sums, chars, lchars)
    n = len(tree.tag)
    mine = [False] * n
    for i in range(n):
        within = i in roots or (i > 0 and mine[tree.parent[i]])
        heavy = i not in roots and tree.tag[i] in BLOCK and tree.tag[i] not in KEEP_TAGS and ltags[i] >= 2 and 2 * lchars[i] > chars[i] and density[i] < least
        mine[i] = within and not tree.out[i] and not heavy
    blocks, parts = [], []
    for i, t in [*tree.texts, (0, None)]:
        if t is None:
            block = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if block:
                blocks.append(block)
            parts.clear()
        elif mine[i]:
            parts.append(t)
    return "\n\n".join(blocks)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, *, html_col: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = [main_text(x) for x in piece.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
