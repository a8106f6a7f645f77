"""Main text of web pages by boosted trees over DOM nodes.

A page is cut at its tags into a tree. Every block element, and every run of
text directly in one, is a node with features: density of text and of links in
its subtree, tokens of its tag and attributes, depth, siblings. Boosted trees
give each node the log-odds of belonging to the article. Decoding goes over the
tree from below: a node is either dropped with all that is in it, or kept and
its children decide for themselves, whichever fits the log-odds better; so no
kept block ever lies inside a dropped one, and none is lost inside a kept one
unless it is dropped as a whole.

The trees are trained here on the nodes of a bounded sample of pages, labelled
by the page's own landmarks (article, main, nav, aside, footer and the like).
Two thirds of the sample pages are varied before: their own words are put into
blocks named like comments, sidebars or notices, and in half of these the
article becomes a plain block with a telling name. A second copy of the training
rows has the landmark features blanked, so that the form of a node counts where
a page has no landmarks.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitystats.llm.boosting import BoostedTrees, fit
from entitystats.llm.common import any_text, col

#: Pages whose nodes the trees are trained on, and characters of each that are used for training.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 60_000
#: Pages whose nodes are weighed together.
TOGETHER = 100

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
SILENT = frozenset("script style noscript template iframe head textarea select option button title object canvas audio video".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a following one of the right side closes without an end tag.
CLOSED_BY = {
    "p": BLOCK - {"html", "body"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "head": frozenset({"body"}),
}
#: Names of the blocks put into sample pages.
VARIED = ("comments", "sidebar", "related posts", "share", "newsletter", "cookie notice", "advert", "promo", "breadcrumbs", "menu", "comment reply", "widget", "site footer", "header", "login form")
MAIN_TAGS, SIDE_TAGS = frozenset({"article", "main"}), frozenset("nav aside footer header form menu dialog".split())
MAIN_WORDS = frozenset("article articlebody content main post entry story body text blog news".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar side aside widget ad ads advert advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "popup modal newsletter subscribe signup login form search share sharing social related recommended comment comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager tags meta byline copyright legal disclaimer toolbar".split()
)
FEATURES = ("main_tag", "side_tag", "main_words", "side_words", "in_main", "in_side", "list", "heading", "paragraph", "text", "link_share", "tags", "density", "depth", "index", "siblings", "stops", "before_main")
LANDMARKS = (0, 1, 2, 3, 4, 5, 17)

#: A quote opens a value only right after ``=``; elsewhere it is a character like any other.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_ENDS = {name: re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I) for name in RAW}


class Node:
    """An element, or a run of text (then ``tag`` is empty)."""

    __slots__ = ("tag", "words", "parent", "kids", "text", "links", "tags", "length", "stops", "depth", "index", "row")

    def __init__(self, tag: str, words: frozenset, parent: Node | None) -> None:
        self.tag, self.words, self.parent = tag, words, parent
        self.kids: list[Node] = []
        self.text, self.row = "", -1
        self.links = self.tags = self.length = self.stops = 0
        self.depth, self.index = (parent.depth + 1, len(parent.kids)) if parent is not None else (0, 0)


def parse(page: str) -> Node:
    """The tree of a page's blocks; inline elements only mark link text.

    Unclosed and stray tags are repaired as browsers mostly do. Comments,
    scripts, styles and drawings leave nothing behind; formulas leave their text.
    """
    root = Node("html", frozenset(), None)
    here, links, at = root, 0, 0
    unclosed: Counter[str] = Counter()  # tags of the open blocks below the root
    drawn: list[str] = []  # open svg elements, and foreignobject elements in them
    run: list[str] = []
    run_links = 0

    def text(piece: str) -> None:
        nonlocal run_links
        if piece and not drawn:
            run.append(piece)
            if links:
                run_links += len(piece)

    def close_run() -> None:
        nonlocal run_links
        if run:
            whole = " ".join(htmllib.unescape("".join(run)).split())
            if whole:
                node = Node("", frozenset(), here)
                node.text, node.length = whole, len(whole)
                node.links, node.stops = min(run_links, len(whole)), sum(map(whole.count, ".!?,"))
                here.kids.append(node)
            run.clear()
            run_links = 0

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name, rest = name.lower(), m.group(3) or ""
        if name == "svg" or drawn and name == "foreignobject":
            if not m.group(1) and not rest.endswith("/"):
                drawn.append(name)
            elif m.group(1) and name in drawn:
                while drawn.pop() != name:
                    pass
            continue
        if drawn and (rest.endswith("/") or name not in RAW):
            # a block ends an svg left open, unless it is foreign content of it
            if name not in BLOCK or "foreignobject" in drawn:
                continue
            drawn.clear()
        if m.group(1):
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK or name == "head":
                close_run()
                if unclosed[name]:
                    while True:
                        unclosed[here.tag] -= 1
                        here, closed = here.parent, here.tag
                        if closed == name:
                            break
                    links = 0
            continue
        if name in RAW:
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            text(" ")
        elif name == "a":
            links += 1
        elif name in BLOCK or name in SILENT:
            close_run()
            while here is not root and here.tag in CLOSED_BY and name in CLOSED_BY[here.tag]:
                unclosed[here.tag] -= 1
                here = here.parent
            if name in ("html", "body") and any(k.tag == name for k in (here, *root.kids)):
                continue
            if name not in VOID and not rest.endswith("/") or name not in VOID and name in BLOCK:
                found = " ".join(x.strip("\"'") for x in _ATTR.findall(rest)).lower() if rest else ""
                node = Node(name, frozenset(_WORD.findall(found)), here)
                here.kids.append(node)
                unclosed[name] += 1
                here, links = node, 0
        elif name not in VOID:
            here.tags += 1
    close_run()
    return root


def nodes(root: Node) -> list[Node]:
    """All nodes, parents first; subtree sums of text, links and tags are filled in."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        node.row = len(order)
        order.append(node)
        waiting.extend(reversed(node.kids))
    for node in reversed(order):
        for kid in node.kids:
            node.length += kid.length
            node.links += kid.links
            node.stops += kid.stops
            node.tags += kid.tags + bool(kid.tag)
    return order


def features(order: list[Node]) -> np.ndarray:
    out = np.zeros((len(order), len(FEATURES)), np.float32)
    reached = False
    for node in order:
        parent = node.parent
        above = out[parent.row] if parent is not None else np.zeros(len(FEATURES))
        own = parent if not node.tag and parent is not None else node
        main, side = len(own.words & MAIN_WORDS), len(own.words & SIDE_WORDS)
        in_main = above[4] or own.tag in MAIN_TAGS or _named_main(own)
        reached = reached or bool(in_main)
        length = node.length
        out[node.row] = (
            own.tag in MAIN_TAGS, own.tag in SIDE_TAGS, main, side, in_main, above[5] or own.tag in SIDE_TAGS or side > 0, own.tag in ("ul", "ol", "li", "menu"), own.tag[:1] == "h" and own.tag[1:].isdigit(),
            own.tag in ("p", "blockquote", "pre"), np.log2(1 + length), node.links / max(1, length), np.log2(1 + node.tags), np.log2(1 + length / (1 + node.tags)), min(node.depth, 20), min(node.index, 20),
            min(len(parent.kids) if parent is not None else 1, 20), 100 * node.stops / max(1, length), not reached,
        )
    return out


def _named_main(node: Node) -> bool:
    return node.tag in ("div", "section") and bool(node.words & MAIN_WORDS) and not node.words & SIDE_WORDS


def weak_labels(order: list[Node]) -> np.ndarray:
    """1: inside an article and in nothing set aside; 0: outside, or set aside; -1: nothing to say.

    Containers that hold article and other blocks alike have no label.
    """
    out = np.full(len(order), -1, np.int8)
    has_main = any(n.tag in MAIN_TAGS or _named_main(n) for n in order)
    side = np.zeros(len(order), bool)
    main = np.zeros(len(order), bool)
    holds = np.zeros(len(order), bool)
    for n in order:
        up = n.parent.row if n.parent is not None else None
        side[n.row] = (up is not None and side[up]) or n.tag in SIDE_TAGS or n.tag in SILENT or bool(n.words & SIDE_WORDS and not n.words & MAIN_WORDS)
        main[n.row] = (up is not None and main[up]) or n.tag in MAIN_TAGS or _named_main(n)
    for n in reversed(order):
        holds[n.row] |= main[n.row] and not side[n.row]
        if n.parent is not None:
            holds[n.parent.row] |= holds[n.row]
    out[side] = 0
    if has_main:
        out[~side & main] = 1
        out[~side & ~main & ~holds] = 0
    return out


def varied(page: str, number: int) -> str:
    """The page itself, or with set-aside blocks of its own words, or with an article that has no landmark."""
    if number % 3 == 0:
        return page
    words = re.sub(r"<[^>]*>", " ", page[len(page) // 3 : len(page) // 3 + 900]).split()
    name = lambda k: VARIED[(number // 3 + k) % len(VARIED)]
    block = lambda k, n: f'<div class="{name(k)}"><p>{htmllib.escape(" ".join(words[k : k + n]), False)}</p><p>{htmllib.escape(" ".join(words[:12]), False)}</p></div>'
    page = re.sub(r"<body([^>]*)>", lambda m: m.group() + block(0, 60), page, count=1, flags=re.I)
    page = re.sub(r"</article>|</main>|<footer", lambda m: block(1, 80) + m.group() + (block(2, 90) if m.group() != "<footer" else ""), page, count=1, flags=re.I)
    if number % 3 == 2:
        kind = ("post-content", "entry content", "article-body", "story")[number // 3 % 4]
        page = re.sub(r"<(?:article|main)\b[^>]*>", f'<div class="{kind}">', page, flags=re.I)
        page = re.sub(r"</(?:article|main)>", "</div>", page, flags=re.I)
    return page


def train(pages: list[str]) -> BoostedTrees:
    xs, ys = [], []
    for number, page in enumerate(pages):
        order = nodes(parse(varied(page, number)))
        y = weak_labels(order)
        xs.append(features(order)[y >= 0])
        ys.append(y[y >= 0])
    x = np.concatenate(xs) if xs else np.zeros((0, len(FEATURES)), np.float32)
    y = np.concatenate(ys) if ys else np.zeros(0)
    blank = x.copy()
    blank[:, LANDMARKS] = 0
    return fit(np.concatenate((x, blank)), np.concatenate((y, y)).astype(float), np.concatenate((np.ones(len(x)), np.full(len(x), 0.25))), rounds=25, depth=4)


def decode(order: list[Node], margin: np.ndarray) -> list[str]:
    """The kept runs of text in page order.

    A run weighs its log-odds times the logarithm of its length; dropping a
    node costs the weights of all below it.
    """
    weight = np.array([m * np.log2(2 + n.length) for n, m in zip(order, margin)])
    total, best = np.zeros(len(order)), np.zeros(len(order))
    keep = np.zeros(len(order), bool)
    for n in reversed(order):
        r = n.row
        if n.tag in SILENT:
            total[r] = best[r] = 0
            continue
        total[r] = weight[r] + sum(total[k.row] for k in n.kids)
        kept = weight[r] + sum(best[k.row] for k in n.kids)
        keep[r] = kept > -total[r] if n.parent is not None else True
        best[r] = max(kept, -total[r]) if n.parent is not None else kept
    out = []
    for n in order:
        if n.parent is not None:
            keep[n.row] &= keep[n.parent.row]
        if keep[n.row] and n.text:
            out.append(n.text)
    return out


def main_texts(pages: list[str], model: BoostedTrees) -> list[str]:
    """The main text of each page; the nodes of some pages are weighed together."""
    out: list[str] = []
    for at in range(0, len(pages), TOGETHER):
        orders = [nodes(parse(page)) for page in pages[at : at + TOGETHER]]
        margins = model.margin(np.concatenate([features(order) for order in orders]))
        ends = np.cumsum([len(order) for order in orders])
        out += [" ".join(decode(order, part)) for order, part in zip(orders, np.split(margins, ends[:-1]))]
    return out


def _extractor(model: BoostedTrees):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(main_texts(list(batch), model), dtype=object)

    return run


def sample(pages: DataFrame, html_col: str = "html", count: int = SAMPLE_PAGES) -> list[str]:
    """At most ``count`` distinct pages, those with the smallest hashes."""
    hashed = pages.where(col(html_col).isNotNull()).select(F.xxhash64(col(html_col)).alias("h"), F.substring(col(html_col), 1, SAMPLE_CHARS).alias("head"))
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(count).collect()]
    rows = hashed.where(F.col("h").isin(least or [None])).groupBy("h").agg(F.min("head").alias("head")).collect()
    return [r["head"] for r in sorted(rows, key=lambda r: r["h"])]


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for every page.

    A null or empty page, or one without an article, has the empty text.
    Repeated rows are extracted each by itself; an empty table gives no rows;
    other columns are not read.
    """
    model = train(sample(pages, html_col))
    text = F.pandas_udf(_extractor(model), "string", F.PandasUDFType.SCALAR_ITER)(any_text(html_col))
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), text.alias("text"))
    return rows.select("*", F.char_length("text").cast("long").alias("n_chars"))
