"""Main text of web pages from parser events: text-to-tag ratios, smoothed and clustered, choose the content region."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTML's elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th section article main blockquote pre figure figcaption hr address details summary aside nav header footer form fieldset center".split())
#: Elements that never hold text of a page; and those whose text is seldom its content.
SILENT = frozenset("script style noscript template iframe object svg canvas button select textarea audio video map math".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog".split())
#: What may stand in a head; any other element ends one whose end was left out.
HEAD = frozenset("title meta link base script style noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies related recommended widget toolbar login signin signup register search pagination pager copyright legal disclaimer skip alert".split())
#: The names that count on an article, a paragraph or a heading, where the others may speak of its looks.
CLEAR_NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter sharing comment comments disqus respond reply replies related recommended widget".split())
#: With one of these in the same name, an element holds content although another part of the name says otherwise.
CONTENT_NAMES = frozenset("content main article post entry story body text page container wrapper layout".split())
#: Elements that are one line of a page each, and no region.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary address".split())
WHOLE = frozenset(("html", "body", "main"))
OWN_NAMES = frozenset(("article", "h1", "h2", "h3", "h4", "h5", "h6", "p"))
#: Standard deviation of the smoothing, in blocks.
SIGMA = 1.5


def names_of(value: str) -> Iterator[set[str]]:
    """The words of each class name or id."""
    for name in value.split():
        yield set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))


class Blocks(HTMLParser):
    """Blocks of text in page order, each with its tags, characters in links and the element around it; and the tree of
    elements. All work is linear: an end tag without an open element is known by a count, one with it closes elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent: list[int] = []  # of each element, by number
        self.kind: list[str] = []
        self.marked: list[bool] = []  # boilerplate by its kind, role or name
        self.ended: list[bool] = []  # closed by a tag of its own or of an element around it
        self.stack: list[int] = []
        self.open: Counter[str] = Counter()
        self.silent = 0
        self.text: list[str] = []
        self.tags = self.link_chars = 0
        self.blocks: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        if said:
            # inline elements are no part of the tree that regions are made of
            at = len(self.stack) - 1
            while at >= 0 and self.kind[self.stack[at]] not in BLOCK and not self.marked[self.stack[at]]:
                at -= 1
            self.blocks.append((said, self.tags, self.link_chars, self.stack[at] if at >= 0 else -1))
        self.text, self.tags, self.link_chars = [], 0, 0

    def is_marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in BOILERPLATE:
            return True
        if tag == "header" and not (self.open["article"] or self.open["main"]):
            return True  # that of an article names it; that of a page does not
        if not attrs or tag in WHOLE:
            return False
        got = dict(attrs)
        if "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in (got.get("style") or "").replace(" ", "").lower():
            return True
        own = tag in OWN_NAMES
        if not own and (got.get("role") or "").lower() in ROLES:
            return True
        bad = CLEAR_NAMES if own else NAMES
        for value in (got.get("class"), got.get("id")):
            for name in names_of(value or ""):
                name = name - {"header"} if tag == "header" else name
                if name & bad and not name & CONTENT_NAMES:
                    return True
        return False

    def handle_starttag(self, tag, attrs):
        if self.open["head"] and tag not in HEAD:
            self.close_all("head")
        if tag == "main" or (tag == "article" and not self.open["aside"]):
            for around in ("nav", "menu", "header", "footer"):  # none holds a page's content: its end was left out
                if self.open[around] and not self.open["main"] and not self.open["article"]:
                    self.close_all(around, ended=False)
        if tag in BLOCK:
            self.flush()
            if tag == "li":  # an open one of its kind ends here
                self.close_near("li", ("ul", "ol", "menu"))
            elif tag != "body" and self.open["p"]:
                self.close_near("p", ("td", "th", "div", "section", "article", "main", "body", "li", "blockquote", "button"))
        elif tag == "br":
            self.text.append(" ")
        self.tags += not self.silent
        if tag in VOID:
            return
        marked = tag in SILENT or self.is_marked(tag, attrs)
        if marked:
            self.flush()
        self.stack.append(len(self.parent))
        self.parent.append(self.stack[-2] if len(self.stack) > 1 else -1)
        self.kind.append(tag)
        self.marked.append(marked)
        self.ended.append(False)
        self.open[tag] += 1
        self.silent += tag in SILENT or tag == "head"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def pop(self, ended: bool = True) -> None:
        n = self.stack[-1]
        tag = self.kind[n]
        if tag in BLOCK or self.marked[n]:
            self.flush()
        self.stack.pop()
        self.ended[n] = ended
        self.open[tag] -= 1
        self.silent -= tag in SILENT or tag == "head"

    def close_all(self, tag: str, ended: bool = True) -> None:
        while self.open[tag]:
            self.pop(ended)

    def close_near(self, tag: str, until: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            kind = self.kind[self.stack[k]]
            if kind == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if kind in until or self.marked[self.stack[k]] or len(self.stack) - k > 64:
                return

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body"):
            return
        if not self.open[tag]:
            return
        while self.kind[self.stack[-1]] != tag:
            self.pop()
        self.pop()
        self.tags += not self.silent

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.open["a"]:
                self.link_chars += len(data.strip())


def smooth(x: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut off at three deviations and renormalised at the ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - reach), min(len(x), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(w, x[lo:hi], strict=True)) / sum(w))
    return out


def threshold(x: list[float]) -> float:
    """The border of two clusters of values by the means of both sides, from the middle until it stands still."""
    cut = (min(x) + max(x)) / 2
    for _ in range(50):
        low, high = [v for v in x if v <= cut], [v for v in x if v > cut]
        if not low or not high:
            break
        moved = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(moved - cut) < 1e-9:
            break
        cut = moved
    return cut


def scores_of(blocks: list[tuple[str, int, int, int]], off: list[bool]) -> list[float]:
    """The smoothed ratio of text to tags of each block: links do not count as text, and blocks of elements that are
    boilerplate have the ratio 0. Both hold before the smoothing and, by a block's own part of plain text, after it."""
    plain = [0 if off[at] else max(len(text) - links, 0) for text, _, links, at in blocks]
    smoothed = smooth([n / max(tags, 1) for n, (_, tags, _, _) in zip(plain, blocks, strict=True)])
    return [r * n / len(text) for r, n, (text, *_) in zip(smoothed, plain, blocks, strict=True)]


def choose(scores: list[float]) -> list[bool]:
    """The upper of two clusters of scores; always with the best."""
    cut, best = threshold(scores), max(scores)
    return [s > cut or s == best for s in scores]


def main_text(html: str | None) -> str:
    """The blocks of the content regions, in page order, joined by newlines; null and empty pages give an empty text.

    Each block is a line of the method: its ratio of text to tags is smoothed and clustered, and the upper cluster is the
    core of the content. Elements adjust this: what is boilerplate by its kind, role or name has the ratio 0, unless its
    end was left out, in which case it says nothing; an article or main element is a region as soon as it has text. The
    region is the innermost element around the whole core, widened to the elements around it as long as they add neither
    boilerplate nor lists of links. Every block of the region stays, short ones and links too, but for boilerplate and
    for lists of links outside articles. Time is linear in the page; a page is one row, whatever its length.
    """
    if not html:
        return ""
    p = Blocks()
    p.feed(html)
    p.close()
    p.flush()
    while p.stack:
        p.pop(ended=False)  # what is still open has no end of its own
    blocks, parent, kind = p.blocks, p.parent, p.kind
    if not blocks:
        return ""
    said = _within(parent, [k in ("article", "main") for k in kind])
    # a form around the article is the page's frame
    frames = _holds(parent, [k in ("article", "main") for k in kind])
    off = _within(parent, [m and (e or k in SILENT) and not (k == "form" and f) for m, e, k, f in zip(p.marked, p.ended, kind, frames, strict=False)])
    if all(off[at] for *_, at in blocks):
        return ""
    scores = scores_of(blocks, off)
    chosen = choose(scores) if max(scores) > 0 else [not off[at] for *_, at in blocks]
    named = [s and not o for s, o in zip(said, off, strict=True)]
    outer = _outer(parent, kind)
    core = [0] * (len(parent) + 1)
    bad = [0] * (len(parent) + 1)
    linky = [links >= 0.8 * len(text) for text, _, links, _ in blocks]
    direct = [False] * (len(parent) + 1)  # elements with a chosen block, or one that is no link, as a child
    for (*_, at), use, link in zip(blocks, chosen, linky, strict=True):
        core[at] += use or named[at]
        direct[outer[at]] |= use or not link
    # a paragraph or list item of links only belongs to the element around it
    menu = [link and not use and not named[at] and not off[at] and not direct[outer[at]] for (*_, at), use, link in zip(blocks, chosen, linky, strict=True)]
    for (*_, at), m in zip(blocks, menu, strict=True):
        bad[at] += off[at] or m
    total = sum(core)
    for k in range(len(parent) - 1, -1, -1):  # parents come first
        core[parent[k]] += core[k]
        bad[parent[k]] += bad[k]
    # the last that holds the core is the innermost; none does if a part of it is in no element
    region = max((k for k in range(len(parent)) if core[k] == total), default=-1)
    region = outer[region]
    while region >= 0 and (parent[region] >= 0 or bad[-1] == bad[region]) and bad[parent[region]] == bad[region]:
        region = parent[region]
    kept = _within(parent, [k == region for k in range(len(parent))])
    return "\n".join(text for (text, _, _, at), use, m in zip(blocks, chosen, menu, strict=True) if (use or not (m or off[at])) and (region < 0 or kept[at]))


def _outer(parent: list[int], kind: list[str]) -> list[int]:
    """Of each element, the innermost around it that is no line: what a paragraph, heading or item stands in."""
    out = [*range(len(parent)), -1]
    for k, up in enumerate(parent):  # parents come first
        if kind[k] in LINES:
            out[k] = out[up]
    return out


def _within(parent: list[int], marked: list[bool]) -> list[bool]:
    """Whether each element or one around it is marked; the last entry, that of element -1, is false."""
    out = [*marked, False]
    for k, up in enumerate(parent):  # parents come first
        out[k] = out[k] or out[up]
    return out


def _holds(parent: list[int], marked: list[bool]) -> list[bool]:
    """Whether an element inside each is marked."""
    out = [False] * (len(parent) + 1)
    for k in range(len(parent) - 1, -1, -1):
        out[parent[k]] |= out[k] or marked[k]
    return out


def extract(html: Column) -> Column:
    """struct<text string, n_chars long> of a column of pages."""

    @F.pandas_udf("text string, n_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            texts = [main_text(h) for h in pages]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    return run(html)
