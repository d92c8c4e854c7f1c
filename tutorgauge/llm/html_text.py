"""Main text of web pages: boosted trees over DOM-node features, decoded down the tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAINING_PAGES = 800  # generated and labelled by construction: the bound of the training sample
TREES, DEPTH, SEED = 20, 5, 42
PAGES_AT_ONCE = 400
LABEL = "data-tutorgauge-article"  # says in generated pages whether an element is article; pages in use have no such attribute

RAW = {"script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PLAIN = INLINE - {"span"}  # share the verdict of the element they stand in
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "body": set()}
TAG_GROUPS = [
    {"article", "main"}, {"section"}, {"div", "span", "center"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd", "menu"},
    {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "select", "option", "label", "fieldset", "input", "textarea", "dialog"}, {"noscript", "template", "svg", "object", "canvas", "audio", "video", "map"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption"},
]
TOKEN_GROUPS = [
    set("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner adsense dfp".split()),
    set("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs".split()),
    set("sidebar side aside rail widget widgets complementary column related recommended recommendations more trending popular also".split()),
    set("comment comments commentlist reply replies respond disqus discussion responses".split()),
    set("footer foot copyright legal contentinfo colophon bottom".split()),
    set("header masthead topbar top banner logo brand site".split()),
    set("cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall message warning".split()),
    set("share sharing social follow twitter facebook tags meta byline".split()),
    set("form search login signin signup register hidden none".split()),
    set("article content post entry story main body text prose page hentry".split()),
]
_G, _K = len(TAG_GROUPS), len(TOKEN_GROUPS)
FEATURES = 2 * _G + 2 * _K + 13
_GROUP_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g}
_TOKENS_OF: dict[str, int] = {}
for _i, _g in enumerate(TOKEN_GROUPS):
    for _t in _g:
        _TOKENS_OF[_t] = _TOKENS_OF.get(_t, 0) | 1 << _i
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


_A, _P, _P_WITHIN = ("a",), ("p",), ("button", "td", "th", "table", "object")


class OpenElements:
    """The open elements, each with the node whose verdict it shares; place 0 is the page.

    The places of every tag are kept as well, so the innermost of some tags is found without a walk, however deep a page is nested.
    """

    __slots__ = ("names", "nodes", "places")

    def __init__(self):
        self.names, self.nodes, self.places = [""], [0], {}

    def node(self) -> int:
        return self.nodes[-1]

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.names))
        self.names.append(tag)
        self.nodes.append(node)

    def pop(self) -> str:
        self.nodes.pop()
        tag = self.names.pop()
        self.places[tag].pop()
        return tag

    def innermost(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if none is open."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)


class Page:
    """Elements that get a verdict of their own, and the page's texts and block edges in order.

    Node 0 is the page. ``events`` has (node, text) for text and (-1, '') where a block starts or ends.
    """

    __slots__ = ("group", "tokens", "parent", "depth", "own", "linked", "marks", "tags", "at", "label", "events")

    def __init__(self, source: str):
        self.group, self.tokens, self.parent, self.depth = [-1], [0], [0], [0]
        self.own, self.linked, self.marks, self.tags, self.at, self.label, self.events = [0], [0], [0], [1], [0], [1], []
        self._read(source)

    def _read(self, source: str) -> None:
        stack = OpenElements()
        at = seen = 0
        raw = ""
        for m in _MARKUP.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                seen = self._text(source[at : m.start()], stack.node(), stack.innermost(_A) > 0, seen)
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if (last := stack.innermost((tag,))) > 0:
                    while len(stack.names) > last:
                        if stack.pop() not in INLINE:
                            self.events.append((-1, ""))
                elif tag not in INLINE:
                    self.events.append((-1, ""))
                continue
            if tag not in INLINE:
                self._close(stack, _P, _P_WITHIN)
                self.events.append((-1, ""))
            if tag in CLOSES:
                self._close(stack, CLOSES[tag], WITHIN[tag])
            over = stack.node()
            if tag == "br":
                self.events.append((over, " "))
            self.tags[over] += 1
            attributes = m[3] if "=" in m[3] or "hidden" in m[3] else ""
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else len(source)
                continue
            if tag in VOID or m[3].endswith("/") and tag in _GROUP_OF and _GROUP_OF[tag] == 11:
                continue
            if tag in PLAIN or tag in ("html", "body") or (tag == "span" and not attributes):
                stack.push(tag, over)
            else:
                self._node(tag, attributes, over, seen)
                stack.push(tag, len(self.group) - 1)
        if at < len(source):
            self._text(source[at:], stack.node(), stack.innermost(_A) > 0, seen)

    def _close(self, stack: OpenElements, tags: Iterable[str], within: Iterable[str]) -> None:
        """Ends the innermost open element of these tags, unless one of ``within`` stands between."""
        last = stack.innermost(tags)
        if last > max(0, stack.innermost(within)):
            while len(stack.names) > last:
                stack.pop()
            self.events.append((-1, ""))

    def _text(self, text: str, node: int, links: int, seen: int) -> int:
        if "&" in text:
            text = entities.unescape(text)
        self.events.append((node, text))
        n = len(text) if not text.isspace() else 0
        self.own[node] += n
        self.marks[node] += text.count(",") + text.count(".")
        if links:
            self.linked[node] += n
        return seen + n

    def _node(self, tag: str, attributes: str, over: int, seen: int) -> None:
        tokens, label = 0, self.label[over]
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role", "aria-label", "style", "itemprop") and (name != "style" or "none" in value):
                for t in _TOKEN.findall(value):
                    tokens |= _TOKENS_OF.get(t.lower(), 0)
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                tokens |= _TOKENS_OF["hidden"]
            elif name == LABEL and value in ("0", "1"):
                label = int(value)
        self.group.append(_GROUP_OF.get(tag, -1))
        self.tokens.append(tokens)
        self.parent.append(over)
        self.depth.append(self.depth[over] + 1)
        for counts in (self.own, self.linked, self.marks):
            counts.append(0)
        self.tags.append(1)
        self.at.append(seen)
        self.label.append(label)

    def text(self, kept) -> str:
        """Texts of kept nodes, white space of a block as one space, blocks on lines of their own."""
        blocks, now = [], []
        for node, text in [*self.events, (-1, "")]:
            if node >= 0:
                if kept[node]:
                    now.append(text)
            elif now:
                if joined := " ".join("".join(now).split()):
                    blocks.append(joined)
                now = []
        return "\n".join(blocks)


class Forest:
    """Nodes of several pages as arrays, with what their subtrees and ancestors hold."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.group) for p in pages])
        self.starts = np.cumsum(sizes) - sizes
        flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
        self.page = np.repeat(self.starts, sizes)
        self.parent = flat("parent") + self.page
        self.depth = flat("depth")
        self.order = np.argsort(self.depth, kind="stable")
        self.levels = np.searchsorted(self.depth[self.order], np.arange(self.depth.max() + 2))
        self.group, self.tokens, self.at, self.label = flat("group"), flat("tokens"), flat("at"), flat("label")
        self.own, self.linked, self.marks, self.tags = (flat(n).astype(float) for n in ("own", "linked", "marks", "tags"))

    def down(self) -> Iterator[np.ndarray]:
        """Nodes by depth, from below the pages on."""
        for a, b in zip(self.levels[1:], self.levels[2:]):
            yield self.order[a:b]

    def subtree(self, own: np.ndarray) -> np.ndarray:
        out = own.copy()
        for nodes in reversed(list(self.down())):
            np.add.at(out, self.parent[nodes], out[nodes])
        return out

    def features(self) -> np.ndarray:
        n = len(self.group)
        own = np.zeros((n, _G + _K))
        has = self.group >= 0
        own[np.flatnonzero(has), self.group[has]] = 1
        own[:, _G:] = self.tokens[:, None] >> np.arange(_K) & 1
        above = np.zeros_like(own)
        for nodes in self.down():
            up = self.parent[nodes]
            above[nodes] = np.maximum(above[up], own[up])
        text, linked, marks, tags = map(self.subtree, (self.own, self.linked, self.marks, self.tags))
        children = np.bincount(self.parent[self.depth > 0], minlength=n).astype(float)
        first = np.full(n, n)
        number = np.arange(n)
        inner = self.depth > 0
        np.minimum.at(first, self.parent[inner], number[inner])
        rank = np.zeros(n)
        by_parent = np.lexsort((number, self.parent))
        by_parent = by_parent[inner[by_parent]]
        if len(by_parent):
            ups = self.parent[by_parent]
            rank[by_parent] = np.arange(len(ups)) - np.searchsorted(ups, ups)
        siblings = children[self.parent]
        share = lambda a, b: a / np.maximum(b, 1)
        whole = text[self.page]
        rest = [
            np.log1p(text), np.log1p(self.own), share(linked, text), np.log1p(share(text, tags)), share(100 * marks, text), self.depth, np.log1p(children),
            share(rank, siblings), np.log1p(siblings), share(text, whole), share(self.at, whole), np.log1p(share(text[self.parent], siblings)), share(linked[self.parent], text[self.parent]),
        ]
        return np.column_stack([own, above, *rest])

    def decode(self, probability: np.ndarray) -> np.ndarray:
        """The most likely verdicts under which what is kept stands only in what is kept; pages themselves are."""
        p = np.clip(probability, 1e-6, 1 - 1e-6)
        out = self.subtree(np.log(1 - p))
        best = np.log(p)
        for nodes in reversed(list(self.down())):
            np.add.at(best, self.parent[nodes], np.maximum(best[nodes], out[nodes]))
        kept = np.ones(len(p), bool)
        for nodes in self.down():
            kept[nodes] = kept[self.parent[nodes]] & (best[nodes] > out[nodes])
        return kept


# --- training pages: random layouts whose parts say themselves whether they are article -----


def _words(draw: random.Random, low: int, high: int) -> str:
    words = ["".join(draw.choice("aeioubcdfglmnprstéü") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(low, high))]
    return " ".join(w + (draw.choice(".,") if draw.random() < 0.12 else "") for w in words).capitalize() + "."


def _tag(name: str, inner: str, keep: int, classes: str = "") -> str:
    return f'<{name} {LABEL}="{keep}"' + (f' class="{classes}"' if classes else "") + f">{inner}</{name}>"


def _links(draw: random.Random, keep: int, low: int = 2, high: int = 12) -> str:
    items = "".join(_tag("li", f'<a href="/x">{_words(draw, 1, 4)}</a>', keep) for _ in range(draw.randint(low, high)))
    return _tag("ul", items, keep)


def _clutter(draw: random.Random) -> str:
    """One part that is not article."""
    pick = lambda group: draw.choice(sorted(TOKEN_GROUPS[group]))
    short, long = _words(draw, 1, 12), _words(draw, 5, 80)
    para = lambda: "".join(_tag("p", _words(draw, 3, 60), 0) for _ in range(draw.randint(1, 4)))
    holder = draw.choice(["div", "section", "div"])
    kinds = [
        lambda: _tag(draw.choice(["div", "span", "section"]), draw.choice([short, long, para()]), 0, pick(0)),
        lambda: _tag("nav", draw.choice([_links(draw, 0), short]), 0, draw.choice(["", pick(1)])),
        lambda: _tag(holder, _links(draw, 0), 0, pick(1)),
        lambda: _tag("aside", draw.choice([para(), _links(draw, 0), _tag("h3", short, 0) + para()]), 0, draw.choice(["", pick(2)])),
        lambda: _tag(holder, _tag("h3", short, 0) + draw.choice([para(), _links(draw, 0)]), 0, pick(2)),
        lambda: _tag(holder, _tag("h3", short, 0) + "".join(_tag("div", _tag("p", _words(draw, 3, 60), 0), 0, "comment") for _ in range(draw.randint(1, 6))), 0, pick(3)),
        lambda: _tag("footer", draw.choice([long, para(), _links(draw, 0), "&copy; " + short]), 0, draw.choice(["", pick(4)])),
        lambda: _tag(holder, draw.choice([short, para()]), 0, pick(4)),
        lambda: _tag("header", draw.choice([_tag("h1", short, 0), _links(draw, 0), _tag("div", short, 0, "logo") + _links(draw, 0)]), 0, draw.choice(["", pick(5)])),
        lambda: _tag(holder, draw.choice([para(), long + "<button>ok</button>"]), 0, pick(6)),
        lambda: _tag(holder, draw.choice([short, _links(draw, 0, 2, 5)]), 0, pick(7)),
        lambda: _tag("form", _tag("label", short, 0) + "<input>" + _tag("button", short, 0), 0, draw.choice(["", pick(8)])),
        lambda: _tag("noscript", long, 0),
    ]
    return draw.choice(kinds)()


def _article(draw: random.Random) -> str:
    """Parts of an article."""
    parts = [_tag(draw.choice(["h1", "h2"]), _words(draw, 1, 12), 1)] if draw.random() < 0.8 else []
    for _ in range(draw.choice([1, 2, 4, 8, 16, 30])):
        high = draw.choice([4, 30, 100, 250])
        parts.append(
            draw.choices(
                [
                    lambda: _tag("p", draw.choice(["", "<b>"]) + _words(draw, 1, high), 1),
                    lambda: _tag("h3", _words(draw, 1, 8), 1),
                    lambda: _tag("ul", "".join(_tag("li", _words(draw, 1, 20), 1) for _ in range(draw.randint(2, 6))), 1),
                    lambda: _tag("blockquote", _tag("p", _words(draw, 3, 40), 1), 1),
                    lambda: _tag("p", f'<a href="/y">{_words(draw, 1, 5)}</a> {_words(draw, 3, 40)}', 1),
                    lambda: _tag("div", _words(draw, 5, 80), 1),
                    lambda: _tag("table", _tag("tr", "".join(_tag("td", _words(draw, 1, 3), 1) for _ in range(3)), 1), 1),
                    lambda: _tag("figure", "<img>" + _tag("figcaption", _words(draw, 2, 12), 1), 1),
                    lambda: _clutter(draw),
                ],
                [30, 3, 3, 2, 3, 3, 1, 1, 3],
            )[0]()
        )
    return "".join(parts)


def training_page(number: int) -> str:
    """A random page; ``LABEL`` tells whether an element is article. The same number gives the same page."""
    draw = random.Random(f"{SEED}-{number}")
    inner = _article(draw)
    body = draw.choice(
        [
            lambda: _tag("article", inner, 1, draw.choice(["", "post", "entry"])),
            lambda: _tag("main", draw.choice([inner, _tag("article", inner, 1)]), 1),
            lambda: _tag("div", inner, 1, draw.choice(["content", "post-body", "article-text", "story", "main"])),
            lambda: _tag("div", _tag("div", inner, 1), 1, draw.choice(["", "page", "wrap"])),
            lambda: inner,
        ]
    )()
    some = lambda: "".join(_clutter(draw) for _ in range(draw.randint(0, 4)))
    return f"<!DOCTYPE html><html><head><title>{_words(draw, 1, 8)}</title></head><body>{some()}{body}{some()}</body></html>"


def trained(spark: SparkSession, pages: int = TRAINING_PAGES, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Gradient-boosted trees as arrays: weight, and per node feature (-1: leaf), threshold, left, right and value.

    Fitted by Spark on the nodes of generated pages, a sample bounded by ``pages``; the model has at most
    ``trees * 2 ** (depth + 1)`` nodes and travels with the tasks.
    """

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forest = Forest([Page(training_page(i)) for i in batch["id"]])
            inner = forest.depth > 0
            yield pd.DataFrame({"label": forest.label[inner].astype(float), "x": list(forest.features()[inner])})

    rows = spark.range(0, pages, 1, 8).mapInPandas(nodes, "label double, x array<double>").select("label", array_to_vector("x").alias("features"))
    return flattened(GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=SEED).fit(rows))


def flattened(model) -> list[tuple]:
    """The trees of a fitted Spark model as arrays."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        feature, threshold, left, right, value = [], [], [], [], []

        def add(node) -> int:
            i = len(feature)
            inner = node.getClass().getSimpleName() == "InternalNode"
            feature.append(node.split().featureIndex() if inner else -1)
            threshold.append(node.split().threshold() if inner else 0.0)
            value.append(node.prediction())
            left.append(i), right.append(i)
            if inner:
                left[i] = add(node.leftChild())
                right[i] = add(node.rightChild())
            return i

        add(tree._call_java("rootNode"))
        out.append((weight, *(np.array(x) for x in (feature, threshold, left, right, value))))
    return out


def probability(model: list[tuple], x: np.ndarray) -> np.ndarray:
    """Of each row to be article."""
    margin = np.zeros(len(x))
    for weight, feature, threshold, left, right, value in model:
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            goes_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def main_texts(model: list[tuple], sources: list[str | None]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    kept = forest.decode(probability(model, forest.features()))
    return [p.text(kept[a : a + len(p.group)]) for p, a in zip(pages, forest.starts)]


_fits: dict[str, list[tuple]] = {}


def session_model(spark: SparkSession) -> list[tuple]:
    """The model with its default parameters, fitted once a session: it depends on nothing else."""
    of = spark.sparkContext.applicationId
    if of not in _fits:
        _fits.clear()
        _fits[of] = trained(spark)
    return _fits[of]


def extracted(pages: DataFrame, html: str = "html", out: str = "text", model: list[tuple] | None = None) -> DataFrame:
    """``pages`` with the main text of the whole page; null or empty html gives an empty text.

    Script, style and title are never text. White space inside a block, line breaks and no-break spaces among it,
    becomes one space. Any number of tags, open or closed, at any depth, is read in time that grows with the page; no page is
    skipped. A column named ``out`` is replaced, other columns are passed on. No rows give no rows, without a fit.
    """
    if pages.isEmpty():
        return pages.withColumn(out, F.lit(""))
    model = model or session_model(pages.sparkSession)

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            found = [t for a in range(0, len(sources), PAGES_AT_ONCE) for t in main_texts(model, sources.iloc[a : a + PAGES_AT_ONCE].tolist())]
            yield pd.Series(found, dtype=object)

    return pages.withColumn(out, texts(F.col(html)))
