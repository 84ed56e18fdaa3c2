"""Main-text extraction: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks. Each block's features are its word count and link density, those of the
blocks before and after it, how strongly the elements around it, out to the nearest article, are marked as a part of the
site (menus, adverts, notices, comments), and whether it is in an article. The tree is grown by CART on the small labelled
table below; nothing but the tree decides about a block.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

# Elements that never hold text of the page, elements inside a line of text, parts of a site, and words
# in a class, id or role that mark such parts.
SILENT = "script style noscript template svg math iframe object canvas audio video select textarea head".split()
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
PARTS = "nav header footer aside form menu dialog button fieldset".split()
MARKS = "ad ads adv advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget header masthead footer foot cookie consent notice alert popup modal overlay subscribe newsletter signup login social share sharing related recommended comment comments reply replies disqus discussion respond pagination pager toolbar form search copyright legal".split()
# Words that say nothing of what an element is.
NEUTRAL = "site main box container wrap wrapper list block section area item items post posts body content left right top bottom inner outer primary secondary global bar row col column group link links text title slot unit zone panel".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_silent, _inline, _parts, _marks, _neutral, _void = map(frozenset, (SILENT, INLINE, PARTS, MARKS, NEUTRAL, VOID))

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "mark", "article")
# mark: 1 for a part of the site by element or by name, less if the name says other things too, 0 without any. article: 1
# in an article, 0.5 on a page without one, 0 outside the article of a page that has one.
# Labelled blocks, features in the order above, then 1 for main text. Written by hand for this operator.
LABELLED = np.array(
    [
        # Menus, adverts, footers, sidebars, notices, forms and comments around an article.
        [1, 1.0, 0, 0.0, 1, 1.0, 1.0, 0.0, 0],
        [1, 1.0, 1, 1.0, 1, 1.0, 1.0, 0.0, 0],
        [2, 1.0, 1, 1.0, 12, 0.0, 1.0, 0.0, 0],
        [14, 0.0, 2, 1.0, 60, 0.0, 1.0, 0.0, 0],
        [7, 0.1, 90, 0.0, 0, 0.0, 1.0, 0.0, 0],
        [90, 0.0, 120, 0.0, 0, 0.0, 1.0, 0.0, 0],
        [5, 0.0, 60, 0.0, 50, 0.0, 0.5, 0.0, 0],
        # The same within an article: related links, share bars, asides, notices, forms, adverts, comments.
        [11, 0.3, 30, 0.0, 4, 1.0, 1.0, 1.0, 0],
        [25, 0.0, 40, 0.0, 70, 0.0, 1.0, 1.0, 0],
        [3, 1.0, 45, 0.0, 30, 0.0, 1.0, 1.0, 0],
        [60, 0.0, 50, 0.0, 20, 0.0, 1.0, 1.0, 0],
        [2, 0.0, 35, 0.0, 3, 0.0, 1.0, 1.0, 0],
        [9, 0.0, 75, 0.0, 80, 0.0, 1.0, 1.0, 0],
        # The same on pages without an article.
        [1, 1.0, 0, 0.0, 1, 1.0, 1.0, 0.5, 0],
        [40, 0.0, 80, 0.0, 6, 0.0, 1.0, 0.5, 0],
        [18, 0.0, 0, 0.0, 0, 0.0, 1.0, 0.5, 0],
        [70, 0.0, 60, 0.0, 65, 0.0, 1.0, 0.5, 0],
        # Unmarked text outside the article.
        [3, 0.0, 1, 1.0, 9, 0.0, 0.0, 0.0, 0],
        [30, 0.0, 2, 1.0, 70, 0.0, 0.0, 0.0, 0],
        [75, 0.0, 90, 0.0, 5, 0.2, 0.0, 0.0, 0],
        [6, 0.8, 70, 0.0, 3, 1.0, 0.0, 0.0, 0],
        [1, 0.0, 80, 0.0, 0, 0.0, 0.0, 0.0, 0],
        # The article: headings, long, short and one-word paragraphs, lists, paragraphs with links, lists of links.
        [8, 0.0, 12, 0.0, 40, 0.0, 0.0, 1.0, 1],
        [3, 0.0, 1, 1.0, 70, 0.0, 0.0, 1.0, 1],
        [70, 0.0, 8, 0.0, 65, 0.0, 0.0, 1.0, 1],
        [1, 0.0, 90, 0.0, 80, 0.0, 0.0, 1.0, 1],
        [2, 0.0, 55, 0.0, 9, 0.1, 0.0, 1.0, 1],
        [4, 0.0, 3, 0.0, 2, 0.0, 0.0, 1.0, 1],
        [45, 0.2, 33, 0.0, 28, 0.0, 0.0, 1.0, 1],
        [6, 1.0, 50, 0.0, 44, 0.0, 0.0, 1.0, 1],
        [120, 0.0, 0, 0.0, 0, 0.0, 0.0, 1.0, 1],
        [1, 0.0, 0, 0.0, 0, 0.0, 0.0, 1.0, 1],
        [5, 1.0, 4, 1.0, 6, 1.0, 0.0, 1.0, 1],
        [12, 0.6, 2, 1.0, 30, 0.0, 0.0, 1.0, 1],
        [2, 0.0, 1, 1.0, 3, 1.0, 0.0, 1.0, 1],
        [1, 0.0, 40, 0.0, 1, 1.0, 0.0, 1.0, 1],
        [6, 0.0, 30, 0.0, 1, 1.0, 0.0, 1.0, 1],
        [30, 0.0, 25, 0.4, 3, 1.0, 0.0, 1.0, 1],
        [1, 1.0, 1, 0.0, 1, 1.0, 0.0, 1.0, 1],
        [2, 1.0, 1, 1.0, 3, 0.0, 0.0, 1.0, 1],
        [1, 1.0, 1, 1.0, 1, 1.0, 0.0, 1.0, 1],
        [3, 0.5, 60, 0.0, 1, 1.0, 0.0, 1.0, 1],
        [16, 0.7, 0, 0.0, 9, 0.8, 0.0, 1.0, 1],
        [7, 0.9, 2, 1.0, 3, 1.0, 0.0, 1.0, 1],
        [2, 0.0, 2, 1.0, 2, 1.0, 0.0, 1.0, 1],
        [9, 0.0, 12, 1.0, 7, 0.9, 0.0, 1.0, 1],
        [2, 0.0, 30, 0.0, 1, 1.0, 0.0, 1.0, 1],
        [10, 0.8, 70, 0.0, 80, 0.0, 0.0, 1.0, 1],
        [3, 0.0, 0, 0.0, 2, 1.0, 0.0, 1.0, 1],
        # In an article, in an element whose name only partly says that it is a part of the site: text stays; links among
        # links, and scraps beside links, go.
        [40, 0.0, 50, 0.0, 60, 0.0, 0.5, 1.0, 1],
        [15, 0.0, 30, 0.0, 25, 0.1, 0.5, 1.0, 1],
        [6, 0.0, 45, 0.0, 40, 0.0, 0.5, 1.0, 1],
        [28, 0.3, 60, 0.0, 35, 0.0, 0.5, 1.0, 1],
        [4, 0.0, 30, 0.2, 22, 0.0, 0.5, 1.0, 1],
        [22, 0.1, 2, 0.0, 2, 1.0, 0.5, 1.0, 1],
        [2, 1.0, 30, 0.0, 2, 1.0, 0.5, 1.0, 0],
        [1, 1.0, 2, 1.0, 1, 1.0, 0.5, 1.0, 0],
        [3, 0.8, 2, 1.0, 50, 0.0, 0.5, 1.0, 0],
        [9, 0.9, 40, 0.0, 38, 0.0, 0.5, 1.0, 0],
        [2, 0.0, 40, 0.0, 1, 1.0, 0.5, 1.0, 0],
        [3, 0.0, 25, 0.0, 2, 1.0, 0.5, 1.0, 0],
        # Pages without an article element: length and link density decide, with the blocks around.
        [60, 0.0, 5, 0.0, 70, 0.0, 0.0, 0.5, 1],
        [90, 0.05, 40, 0.0, 3, 1.0, 0.0, 0.5, 1],
        [22, 0.0, 50, 0.0, 45, 0.1, 0.0, 0.5, 1],
        [5, 0.0, 2, 1.0, 60, 0.0, 0.0, 0.5, 1],
        [7, 0.0, 30, 0.0, 64, 0.0, 0.0, 0.5, 1],
        [2, 0.0, 60, 0.0, 50, 0.0, 0.0, 0.5, 1],
        [14, 0.0, 0, 0.0, 35, 0.0, 0.0, 0.5, 1],
        [18, 0.0, 40, 0.0, 0, 0.0, 0.0, 0.5, 1],
        [25, 0.0, 0, 0.0, 0, 0.0, 0.0, 0.5, 1],
        [3, 0.0, 0, 0.0, 0, 0.0, 0.0, 0.5, 1],
        [33, 0.0, 20, 0.0, 41, 0.0, 0.5, 0.5, 1],
        [4, 1.0, 3, 1.0, 5, 1.0, 0.0, 0.5, 0],
        [1, 1.0, 0, 0.0, 1, 1.0, 0.0, 0.5, 0],
        [20, 0.9, 2, 1.0, 30, 0.0, 0.0, 0.5, 0],
        [35, 0.7, 60, 0.0, 4, 1.0, 0.0, 0.5, 0],
        [6, 0.6, 80, 0.0, 2, 1.0, 0.0, 0.5, 0],
        [12, 0.5, 3, 1.0, 5, 0.8, 0.0, 0.5, 0],
        [2, 0.0, 2, 1.0, 3, 1.0, 0.0, 0.5, 0],
        [4, 0.0, 1, 1.0, 2, 1.0, 0.0, 0.5, 0],
    ],
    dtype=np.float64,
)


def grow(table: np.ndarray, depth: int = 8, least: int = 1) -> dict:
    """CART by Gini impurity; ties go to the first feature and the lowest cut."""
    labels = table[:, -1]
    leaf = {"label": int(labels.mean() >= 0.5)}
    if depth == 0 or len({*labels}) == 1:
        return leaf
    best = None
    for feature in range(table.shape[1] - 1):
        values = np.unique(table[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            left = table[:, feature] <= cut
            if min(left.sum(), (~left).sum()) < least:
                continue
            gini = sum(side.sum() * (p := labels[side].mean()) * (1 - p) for side in (left, ~left))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, feature, float(cut), left)
    if best is None:
        return leaf
    _, feature, cut, left = best
    return {"feature": feature, "cut": cut, "low": grow(table[left], depth - 1, least), "high": grow(table[~left], depth - 1, least)}


def decide(tree: dict, row: tuple) -> int:
    while "label" not in tree:
        tree = tree["low"] if row[tree["feature"]] <= tree["cut"] else tree["high"]
    return tree["label"]


def mark(name: str, attributes: str, in_article: bool) -> float:
    """How strongly an element is marked as a part of the site, by its name or by the words in its class, id and role."""
    if name in _parts and not (name == "header" and in_article):  # a header within an article is its heading
        return 1.0
    if not attributes or name in ("html", "body", "main"):
        return 0.0
    most = 0.0
    for a in ATTRIBUTE.finditer(attributes):
        for token in (a[2] or a[3] or a[4] or "").split():
            words = {w for w in re.split(r"[^a-z]+", HUMP.sub("-", token).lower()) if w and w not in _neutral}
            if words and (marked := len(words & _marks)):
                most = max(most, marked / len(words))
    return most


def blocks(page: str) -> list[tuple[str, int, int, float, bool]]:
    """Flat text blocks: text, words, words in links, mark, in an article."""
    out: list[tuple[str, int, int, float, bool]] = []
    # Open elements that are not inline, with the mark out to the nearest article, and whether they are in one.
    stack: list[tuple[str, float, bool]] = [("", 0.0, False)]
    links = 0
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if text:
            block = " ".join("".join(text).split())
            if block:
                out.append((block, block.count(" ") + 1, len("".join(linked).split()), *stack[-1][1:]))
            text.clear()
            linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if (m.start() if m else n) > at:
            raw = page[at : m.start() if m else n]
            raw = entities.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if links:
                linked.append(raw)
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _silent and name != "head":
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            text.append(" ") if text else None
            continue
        if name == "head":
            if not m[1]:
                end = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                at = (end.end() if end[0][1] == "/" else end.start()) if end else at
            continue
        if name in _inline:
            if name == "a":
                links = 0 if m[1] else 1
            elif name in ("br", "img", "wbr"):
                text.append("" if name == "wbr" else " ")
            continue
        flush()
        if m[1]:
            links = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in CLOSES_P and stack[-1][0] == "p" or name == "li" and stack[-1][0] == "li":
            stack.pop()
        if name in _void or m[3].endswith("/"):
            continue
        _, outer, inside = stack[-1]
        own = mark(name, m[3], inside)
        if name == "article" and own < 1:
            stack.append((name, own, True))
        else:
            stack.append((name, max(outer, own), inside))
    flush()
    return out


def features(found: list[tuple[str, int, int, float, bool]]) -> list[tuple[float, ...]]:
    """FEATURES of each block; before the first and after the last there are no words."""
    sizes = [(0, 0.0), *((words, min(1.0, linked / words)) for _, words, linked, _, _ in found), (0, 0.0)]
    outside = 0.0 if any(b[4] for b in found) else 0.5
    return [(*sizes[k + 1], *sizes[k], *sizes[k + 2], b[3], 1.0 if b[4] else outside) for k, b in enumerate(found)]


def main_text(page: str | None, tree: dict) -> str:
    """The kept blocks joined by a line end; a null or empty page has none."""
    found = blocks(page) if page else []
    return "\n".join(b[0] for b, row in zip(found, features(found)) if decide(tree, row))


def extract(pages: DataFrame, labelled: np.ndarray = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of each page.

    Rows come as they are, nulls and repeated ones too; no rows give none; other columns are ignored. A null or empty
    page, or one without main text, has an empty text. A very long page is parsed whole, in the memory of one task.
    """
    tree = grow(labelled)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
