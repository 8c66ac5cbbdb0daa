"""Main text of web pages from flat text blocks.

A page is cut into text blocks at its block-level tags. Each block has its
word count and link density, those of its neighbours, and three marks of where
it stands; a decision tree trained on the small labelled table of
``html_samples`` says which blocks are the article. The tree is a few nested
conditions and goes to the tasks with the code; pages are only mapped.

Defined results: a null or empty html, or one without article blocks, gives
the empty string; only scripts, styles, the head, and closed svg, iframe and
template elements have no text; a head ends where the body begins, by its tag
or another's, and a self-closed element is empty; a page cut off inside a tag loses that tag, one cut off
inside an element ends it there; repeated pages are rows like any other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trolley.llm.shared import table

#: Comments, scripts and styles, declarations, tags; what stands between is text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr canvas iframe noscript object script style svg template "
    "annotation annotation-xml maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, if they end; HTML tags that end an open svg; tags that leave a head open.
HIDDEN = frozenset(("iframe", "svg", "template"))
ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements around an article, and words in the names of such elements.
AROUND = frozenset("nav aside footer form button select dialog menu textarea fieldset".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies dialog discussion footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification pagination popup promo promotion promoted related replies reply respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
INSIDE = frozenset(("article", "main"))


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    around: int  # inside an element around articles, by its tag or name
    inside: int  # inside an article or main element
    heading: int


def _around(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in AROUND or tag == "header" and not in_article:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    names = " ".join(m[1] for m in _NAMES.finditer(attributes)) if "=" in attributes else ""
    return not HINTS.isdisjoint(_WORD.findall(names.lower())) if names else False


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty text blocks in order, white space inside each as one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open block elements: tag, whether it stands around articles
    around = inside = heading = links = 0
    held: list[tuple[str, bool]] = []
    hidden: list[str] = []  # an open element without text of the page, and what is open in it
    in_head = False
    ends: dict[str, int] = {}

    def say(text: str) -> None:
        nonlocal in_head
        if hidden or in_head and not text.strip():
            return
        in_head = False
        held.append((html.unescape(text), links > 0))

    def has_end(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(f"</{tag}\\b", page, re.I)), default=-1)
        return ends[tag] >= at

    def hides(tag: str, closing: str, attributes: str) -> bool:
        """Whether a tag in a hidden element leaves it open or ends it; not if the page goes on with this tag."""
        if closing:
            if tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
                return True
        elif not attributes.endswith("/>"):
            if hidden[0] == "svg" and tag not in ENDS_SVG or hidden[0] == tag == "template":
                hidden.append(tag)
        over = hidden[0] == "svg" and (closing or tag in ENDS_SVG)
        if over or hidden[0] == "title" and tag not in INLINE and tag not in IN_HEAD | VOID:
            hidden.clear()
            return False
        return True

    def flush() -> None:
        text = " ".join("".join(t for t, _ in held).split())
        if text:
            linked = sum(len(t.split()) for t, link in held if link)
            words = text.count(" ") + 1
            out.append(Block(text, words, min(1.0, linked / words), int(around > 0), int(inside > 0), int(heading > 0)))
        held.clear()

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or hidden and hides(tag, m[2], m[4]):
            continue
        empty = m[4].endswith("/>")
        if tag == "head":
            flush()
            in_head = not m[2]
            continue
        if in_head:
            if tag == "title" and not m[2] and not empty:
                hidden.append(tag)
            in_head = tag in IN_HEAD or bool(m[2]) and tag not in ("body", "html")
            if in_head and tag != "template":
                continue
        if tag in HIDDEN:
            if not m[2] and not empty and has_end(tag, at):
                hidden.append(tag)
            continue
        if tag == "a":
            links = max(0, links + (-1 if m[2] else 1))
        if tag == "br":
            held.append((" ", False))
        if tag in VOID:
            continue
        if tag in INLINE and not (not m[2] and _around(tag, m[4], inside > 0)):
            if m[2] and stack and any(t == tag for t, _ in stack):
                flush()
            else:
                continue
        else:
            flush()
        if tag not in INLINE:
            links = 0
        if not m[2]:
            mark = _around(tag, m[4], inside > 0)
            if tag == "p" and not mark:
                continue
            stack.append((tag, mark))
            around += mark
            inside += tag in INSIDE
            heading += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        elif any(t == tag for t, _ in stack):
            while True:
                t, mark = stack.pop()
                around -= mark
                inside -= t in INSIDE
                heading -= len(t) == 2 and t[0] == "h" and t[1].isdigit()
                if t == tag:
                    break
    if at < len(page):
        say(page[at:])
    flush()
    return out


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "around", "inside", "heading", "page_has_inside",
)


def features(page: list[Block]) -> np.ndarray:
    own = np.array([b[1:] for b in page], np.float64).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:, :2]])[:-1], np.concatenate([own[:, :2], edge])[1:]
    any_inside = np.full((len(own), 1), own[:, 3].max(initial=0))
    return np.hstack([own[:, :2], before, after, own[:, 2:], any_inside])


class Tree(NamedTuple):
    """A decision tree: an inner node has a feature and a threshold, a leaf the share of article blocks."""

    feature: int
    threshold: float
    low: object
    high: object

    def judge(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        low = x[:, self.feature] <= self.threshold
        for side, child in ((low, self.low), (~low, self.high)):
            out[side] = child.judge(x[side]) if isinstance(child, Tree) else child
        return out


def train(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree | float:
    """A tree of best Gini splits, ties to the first feature and the lowest threshold."""
    best: tuple[float, int, float] | None = None
    if depth and 0 < y.sum() < len(y):
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            a, b = ones[:-1], ones[-1] - ones[:-1]
            impurity = a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n)
            for j in np.flatnonzero(cut):
                if best is None or impurity[j] < best[0] - 1e-12:
                    best = impurity[j], k, (v[j] + v[j + 1]) / 2
    if best is None:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], train(x[low], y[low], depth - 1, least), train(x[~low], y[~low], depth - 1, least))


@functools.cache
def trained() -> Tree:
    from trolley.llm.html_samples import labelled

    x, y = [], []
    for page, wanted in labelled():
        found = blocks(page)
        x.append(features(found))
        y += [float(b.text in wanted) for b in found]
    return train(np.concatenate(x), np.array(y))


def article(page: str | None, tree: Tree) -> list[Block]:
    """The blocks of the article, in page order."""
    found = blocks(page)
    if not found:
        return []
    return [b for b, p in zip(found, tree.judge(features(found))) if p >= 0.5]


def _extracted(tree: Tree, headings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                " ".join(b.text for b in article(page, tree) if headings or not b.heading)
                for page in batch.column("html").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    return run


def extract(pages: DataFrame, key: Column, headings: bool = True) -> DataFrame:
    """(key, text) of every page."""
    own = pages.select(key.alias("key"), F.col("html").cast("string").alias("html"))
    schema = own.select("key", F.lit("").alias("text")).schema
    return own.mapInArrow(_extracted(trained(), headings), schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    found = extract(table(spark, sf_dir, "pages"), F.struct("page_id", "url"))
    return found.select("key.page_id", "key.url", "text", F.length("text").cast("long").alias("n_chars"))
