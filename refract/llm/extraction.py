"""Main text of HTML pages from flat text blocks.

A page is cut into blocks at block-level tags.  What the parser knows is HTML's
syntax only.  Each block has its number of words and link density, those of its
neighbours (-1: none), its place in the tree, what enclosing elements say of
themselves by tag, class, id and role (navigation, footer, comments ... or
article, main) with the share of the page's words that they hold, and its
distance from the element that holds most of the text.  A decision tree over
these, trained on labelled pages (:mod:`refract.llm.labelled_pages`), keeps or
drops it.

Defined results: a null or empty page, and one without kept blocks, gives an
empty text; broken markup is read as far as it goes; repeated rows are pages
like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refract.llm import labelled_pages
from refract.llm.common import read, text_slices

#: Elements whose begin and end part blocks.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
section summary table tbody tfoot thead tr ul""".split())
#: Elements whose content is no text (in an object it is what stands in for
#: it; a button is text in a heading only; an annotation repeats a formula).
SILENT = frozenset("""script style noscript template svg head title iframe object audio video canvas select
option button textarea datalist map annotation annotation-xml""".split())
#: What can stand in a head; anything else ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What holds paragraphs.
HOLDERS = frozenset("article aside blockquote body center dd details dialog div fieldset footer form header html main menu nav section td th".split())
#: A begin of one of these ends an open one of the same.
SELF_CLOSING = frozenset("p li dt dd tr option".split())
#: Elements, and words in class, id and role, that say what a part of a page is.
AWAY = frozenset("nav footer aside menu dialog".split())
HEADER = frozenset("header form".split())
TOWARDS = frozenset("article main".split())
AWAY_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsbygoogle adsense alert aside banner breadcrumb breadcrumbs cc colophon
comment commentlist comments consent cookie cookies copyright discussion disqus dropdown feedback foot footer gdpr login menu modal nav navbar
navigation newsletter next notice notices notification notifications pager pagination popup privacy promo promos promotion rail recommended related
replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets""".split())
HEADER_WORDS = frozenset("byline head header masthead meta tags top".split())
TOWARDS_WORDS = frozenset("article articlebody body content entry hentry main post story text".split())
#: Class names that tell of a page's or a post's kind, not what an element is.
SAYS_NOTHING = re.compile(r"(?:has|no|with|without|tag|category|cat|format|type|status)[_-].*", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "depth",
            "away_share", "away_nearest", "header_share", "towards_share", "nearest", "holder_share", "in_main", "from_main", "before_main", "blocks")


def said(at: dict[str, str]) -> set[str]:
    """The words of class, id and role."""
    names = [t for k in ("class", "id", "role") for t in at.get(k, "").split()]
    return {w.lower() for t in names if not SAYS_NOTHING.fullmatch(t) for w in _WORD.findall(t)}


class Element:
    """``away``, ``header``, ``towards``: what its tag and names say; ``words``:
    how many lie in it."""

    __slots__ = ("tag", "above", "depth", "away", "header", "towards", "mark", "silent", "words", "plain")

    def __init__(self, tag: str, above: Element | None, at: dict[str, str], silent: bool = False) -> None:
        words = said(at)
        hidden = "hidden" in at or "none" in at.get("style", "").replace(" ", "").partition("display:")[2][:4]
        self.tag, self.above, self.silent, self.words, self.plain = tag, above, silent, 0, 0
        self.depth = above.depth + 1 if above else 0
        page = tag in ("html", "body")
        self.away = not page and (tag in AWAY or hidden or not words.isdisjoint(AWAY_WORDS))
        self.header = not page and (tag in HEADER or not words.isdisjoint(HEADER_WORDS))
        self.towards = not page and (tag in TOWARDS or at.get("itemprop") == "articleBody" or not words.isdisjoint(TOWARDS_WORDS))
        self.mark = at.get("y", above.mark if above else None)

    def path(self) -> Iterator[Element]:
        e = self
        while e is not None:
            yield e
            e = e.above


class Blocks(HTMLParser):
    """The text blocks of a page: (text, words, words in links, element)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, {})
        self.open: list[Element] = [self.root]
        self.silent = self.links = 0
        self.parts: list[tuple[str, bool]] = []
        self.blocks: list[tuple[str, int, int, Element]] = []

    def flush(self) -> None:
        if self.parts:
            words = "".join(t for t, _ in self.parts).split()
            if words:
                linked = min(sum(len(t.split()) for t, a in self.parts if a), len(words))
                at = self.open[-1]
                for e in at.path():
                    e.words += len(words)
                holder = at
                while holder.tag not in HOLDERS and holder.above:
                    holder = holder.above
                holder.plain += len(words) - linked
                self.blocks.append((" ".join(words), len(words), linked, at))
            self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in SILENT and not (tag == "button" and any(e.tag in HEADINGS for e in self.open)):
            self.silent += 1
            self.open.append(Element(tag, self.open[-1], {}, True))
            return
        if tag in BLOCK:
            self.flush()
            if tag in SELF_CLOSING or tag[0] == "h" and tag[1:].isdigit():
                self._close_before(tag)
        elif tag in ("br", "td", "th"):
            self.parts.append((" ", False))
        if tag in VOID:
            return
        self.links += tag == "a"
        self.open.append(Element(tag, self.open[-1], {k: v or "" for k, v in attrs}))

    def _end_head(self):
        if self.open[-1].tag == "head":
            self._pop(len(self.open) - 1)

    def _close_before(self, tag):
        """``<p>`` ends an open paragraph of the same enclosing element."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop(i)
                return
            if self.open[i].tag in BLOCK and self.open[i].tag not in SELF_CLOSING:
                return

    def _pop(self, i):
        for e in self.open[i:]:
            self.links -= e.tag == "a"
            self.silent -= e.silent
        del self.open[i:]

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._pop(i)
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return                                # an inline end doesn't close blocks

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)              # "<div/>" opens a div in HTML

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append((data, self.links > 0))


def blocks_of(html: str) -> list[tuple[str, int, int, Element]]:
    p = Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.blocks


def table(blocks: list[tuple[str, int, int, Element]]) -> np.ndarray:
    """The features of a page's blocks.  Shares are of the page's words: of the
    innermost element around a block that says "away" (2: none), of the outermost
    one below any that says "towards", and so on; ``main`` is the element whose
    own paragraphs hold the most words outside links."""
    n = len(blocks)
    total = max(1, sum(b[1] for b in blocks))
    words = np.array([-1, *[b[1] for b in blocks], -1], float)
    links = np.array([-1, *[b[2] / max(1, b[1]) for b in blocks], -1], float)
    holders = []
    for b in blocks:
        e = b[3]
        while e.tag not in HOLDERS and e.above:
            e = e.above
        holders.append(e)
    main = max(holders, key=lambda e: e.plain) if holders else None
    inside = [any(x is main for x in b[3].path()) for b in blocks]
    places = np.flatnonzero(inside)
    own = np.zeros((n, len(FEATURES) - 6))
    for i, (_, _, _, at) in enumerate(blocks):
        away = nearest_away = header = 2.0
        towards = nearest = 0.0
        heading = item = False
        for k, e in enumerate(at.path()):
            heading |= k < 3 and e.tag in HEADINGS
            item |= k < 3 and e.tag in ("li", "dd", "dt", "td", "th")
            if e.away:
                away = min(away, e.words / total)
                if nearest <= 0:
                    nearest_away = e.words / total        # the outermost one that no article parts from the block
                nearest = nearest or -1.0
            if e.header and header == 2.0:
                header = e.words / total
            if e.towards:
                towards = towards or e.words / total
                nearest = nearest or 1.0
        own[i] = (heading, item, at.depth, away, nearest_away, header, towards, nearest, holders[i].words / total, inside[i],
                  min(20, np.abs(places - i).min()) if len(places) else 20, len(places) and i < places[0], min(n, 50))
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own]) if n else np.zeros((0, len(FEATURES)))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4):
    """A CART tree: a share of ones, or (feature, limit, at most, above)."""
    share = float(y.mean())
    n = len(y)
    if depth == 0 or share in (0.0, 1.0) or n < 2 * least:
        return share
    best = (n * share * (1 - share) - 1e-9, None, None)
    count = np.arange(1, n)
    for f in range(x.shape[1]):
        o = np.argsort(x[:, f], kind="stable")
        v, ones = x[o, f], np.cumsum(y[o])
        low, high = ones[:-1], ones[-1] - ones[:-1]
        impurity = low * (1 - low / count) + high * (1 - high / (n - count))
        ok = (v[1:] > v[:-1]) & (count >= least) & (n - count >= least)
        if ok.any():
            k = int(np.where(ok, impurity, np.inf).argmin())
            if impurity[k] < best[0] - 1e-9:
                best = (impurity[k], f, float(v[k] + v[k + 1]) / 2)
    _, f, lim = best
    if f is None:
        return share
    low = x[:, f] <= lim
    return f, lim, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, row) -> float:
    while isinstance(tree, tuple):
        f, lim, low, high = tree
        tree = low if row[f] <= lim else high
    return tree


#: How many labelled pages the tree learns from, and which.
TRAIN_PAGES, TRAIN_SEED = 1500, 11


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks that say which they have."""
    x, y = [], []
    for html in pages:
        b = blocks_of(html)
        for row, block in zip(table(b), b):
            if block[3].mark is not None:
                x.append(row)
                y.append(float(block[3].mark == "1"))
    return np.array(x), np.array(y)


@cache
def train(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED):
    """The tree of so many labelled pages."""
    return grow(*labelled(labelled_pages.pages(pages, seed)))


def main_text(html: str | None, tree) -> str:
    if not html:
        return ""
    b = blocks_of(html)
    return "\n\n".join(block[0] for block, row in zip(b, table(b)) if decide(tree, row) >= 0.5) if b else ""


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "html"):
            text = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()),
                                              pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of each row."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = {c: p.schema[c].dataType.simpleString() for c in p.columns}
    return p.mapInArrow(_extract(train()), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
