"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat row of text blocks, cut at block-level tags. A block's features
are its word count and link density and those of the blocks before and after it, and
the kind of element that each of the three stands in: paragraph, list item or heading,
or a part of the page that HTML itself sets apart, such as nav, aside, footer or form.
Class names and ids are not looked at. A decision tree, trained here on the blocks of a
small labelled table of pages, tells main text from the rest.

Pages are read by one scan that moves forwards only, in time and memory proportional
to the page, whatever is unclosed, nested or quoted in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrove.llm.common import table
from linkgrove.llm.htmltrain import pages

#: Pages whose blocks are classified at once.
PAGES = 200
# Element names of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark math mi mn mo mrow ms msub msup mtext nobr q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
SPACES = frozenset(["br", "img"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and no text of the page, up to their end tag.
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Their content is not shown as text; they end with the element around them at the latest.
UNSEEN = frozenset("noscript template svg object canvas video audio datalist".split())
#: What HTML sets apart from the text of a page.
APART = frozenset("nav footer aside form menu dialog button select head fieldset".split())
PARAGRAPH = frozenset("p blockquote pre article main section".split())
ITEM = frozenset("li dd dt td th".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open elements, up to the nearest of the second set.
CLOSES = {
    "li": (("li",), ("ul", "ol")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"[\"'>]")
_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}

MARKS = ("paragraph", "item", "heading", "apart")
FEATURES = ("words", "links", *MARKS)
FEATURES = (*FEATURES, *(f"previous {f}" for f in FEATURES), *(f"next {f}" for f in FEATURES))


@dataclass
class TextBlock:
    text: str
    words: int
    linked: int
    paragraph: bool
    item: bool
    heading: bool
    apart: bool
    label: bool


class _Open:
    """The open elements: each with what holds for text inside, and where the nearest of a name is."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> tuple[str, bool, bool, bool, bool]:
        """(name, apart, unseen, in an article, labelled)."""
        return self.stack[-1] if self.stack else ("", False, False, False, False)

    def nearest(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def push(self, name: str, label: bool) -> None:
        _, apart, unseen, article, labelled = self.top()
        # a header heads the page unless it is an article's; an article in an article is a reply to it
        apart = apart or name in APART or (name == "header" and not article) or (name == "article" and article)
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, apart, unseen or name in UNSEEN, article or name == "article" or name == "main", labelled or label))


def _tag_end(page: str, at: int) -> int:
    """Where the tag whose attributes start at `at` has its `>`, outside of quotes if these close; -1: nowhere."""
    while found := _QUOTE.search(page, at):
        if found[0] == ">":
            return found.start()
        close = page.find(found[0], found.end())
        if close < 0:
            return page.find(">", found.end())
        at = close + 1
    return -1


def blocks(page: str, labels: bool = False) -> list[TextBlock]:
    """The page's text blocks in order; with `labels`, data-main inside an element's tag labels its text."""
    out: list[TextBlock] = []
    opened = _Open()
    text: list[str] = []
    linked: list[str] = []
    in_link = False

    def add(body: str) -> None:
        plain = html.unescape(body) if "&" in body else body
        text.append(plain)
        if in_link:
            linked.append(plain + " ")

    def end() -> None:
        if text:
            words = "".join(text).split()
            name, apart, unseen, _, label = opened.top()
            if words and not unseen:
                out.append(
                    TextBlock(
                        " ".join(words), len(words), len("".join(linked).split()), name in PARAGRAPH, name in ITEM, name in HEADING, apart, label
                    )
                )
            text.clear()
            linked.clear()

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            close = page.find("-->", start + 2)  # an open comment holds the rest of the page
            at = close + 3 if close >= 0 else size
            continue
        if page.startswith(("<!", "<?"), start):
            close = page.find(">", start)
            at = close + 1 if close >= 0 else size
            continue
        closing = page.startswith("/", start + 1)
        found = _NAME.match(page, start + 1 + closing)
        if not found:
            add("<")
            at = start + 1
            continue
        close = _tag_end(page, found.end())
        if close < 0:  # no tag ends from here on: what is left is text but for a tag cut off at the end
            last = page.rfind("<")
            add(page[start : last if _NAME.match(page, last + 1) or page.startswith("</", last) else size])
            break
        name, attributes = found[0].lower(), page[found.end() : close]
        at = close + 1
        if name in INLINE or name == "br":
            if name == "a":
                in_link = not closing
            elif name in SPACES:
                text.append(" ")
            continue
        end()
        if closing:
            place = opened.nearest((name,))
            if place >= 0:
                opened.cut(place)
            in_link = in_link and name in ("p", "div")
            continue
        if opened.top()[0] == "p":
            opened.cut(len(opened.stack) - 1)
        if name in CLOSES:
            own, around = CLOSES[name]
            place = opened.nearest(own)
            if place > opened.nearest(around):
                opened.cut(place)
        if name in RAW:
            last = _END[name].search(page, at)
            at = (page.find(">", last.start()) + 1 or size) if last else size
        elif name not in VOID and not (attributes.endswith("/") and name in UNSEEN):
            opened.push(name, labels and "data-main" in attributes)
    end()
    return out


def features(row: list[TextBlock]) -> np.ndarray:
    """(blocks x FEATURES) of a page; missing neighbours count as empty."""
    own = np.array([(b.words, min(b.linked / b.words, 1.0), b.paragraph, b.item, b.heading, b.apart) for b in row], np.float64)
    own = own.reshape(len(row), 2 + len(MARKS))
    none = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:]])


class DecisionTree:
    """Binary classification tree by Gini impurity; ties go to the first feature and lowest cut."""

    def __init__(self, depth: int = 10, least: int = 4):
        self.depth, self.least = depth, least
        self.nodes: list[tuple[int, float, int, int, bool]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.nodes = []
        self._grow(x, y.astype(np.float64), self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(y.mean() >= 0.5)))
        if depth == 0 or len(y) < 2 * self.least or y.min() == y.max():
            return me
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            left = np.arange(1, len(y))
            ok = (v[1:] != v[:-1]) & (left >= self.least) & (len(y) - left >= self.least)
            if not ok.any():
                continue
            a, b = ones[:-1] / left, (ones[-1] - ones[:-1]) / (len(y) - left)
            gini = np.where(ok, 2 * a * (1 - a) * left + 2 * b * (1 - b) * (len(y) - left), np.inf)
            at = int(np.argmin(gini))
            if gini[at] < best[0]:
                best = (gini[at], k, (v[at] + v[at + 1]) / 2)
        if best[1] < 0:
            return me
        low = x[:, best[1]] <= best[2]
        left_node = self._grow(x[low], y[low], depth - 1)
        right_node = self._grow(x[~low], y[~low], depth - 1)
        self.nodes[me] = (best[1], best[2], left_node, right_node, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        out = np.zeros(len(x), bool)
        feature = np.array([n[0] for n in self.nodes])
        cut = np.array([n[1] for n in self.nodes])
        children = np.array([n[2:4] for n in self.nodes])
        value = np.array([n[4] for n in self.nodes])
        todo = np.arange(len(x))
        while len(todo):
            leaf = feature[at[todo]] < 0
            out[todo[leaf]] = value[at[todo[leaf]]]
            todo = todo[~leaf]
            node = at[todo]
            at[todo] = children[node, (x[todo, feature[node]] > cut[node]).astype(np.int64)]
        return out


def labelled_table(without: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training pages' blocks, those of one layout left out."""
    rows = [blocks(p, labels=True) for name, p in pages() if name != without]
    return np.vstack([features(r) for r in rows]), np.array([b.label for r in rows for b in r])


@cache
def classifier() -> DecisionTree:
    return DecisionTree().fit(*labelled_table())


def main_texts(texts: Iterable[str | None]) -> list[str]:
    """Main blocks of each page joined by newlines; null, empty or blockless pages give the empty text."""
    rows = [blocks(t or "") for t in texts]
    keep = iter(classifier().predict(np.vstack([np.empty((0, len(FEATURES))), *map(features, rows)])).tolist())
    return ["\n".join([b.text for b in row if next(keep)]) for row in rows]


def main_text(page: str | None) -> str:
    return main_texts([page])[0]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            part = batch.slice(at, PAGES)
            texts = main_texts(h.as_py() for h in part.column(2))
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(table_of_pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per input row, nothing shuffled.

    Null page_id or url pass through; null html gives the empty text. Repeated rows
    stay. Other columns are ignored.
    """
    return table_of_pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
