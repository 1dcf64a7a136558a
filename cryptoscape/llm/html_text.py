"""Main text of HTML pages: a tree-structured graphical model over the DOM.

Block elements are nodes; each is content or not. Class words, own text length and link density
speak for either (emissions by kind of element); a node depends on its parent (edge potentials by
kind of element). What is rare for a kind leans on all kinds together. Sum-product messages go up the tree and down again, which gives the exact probability of
content for every node, and the text of the likely ones is the page's text. Potentials are counts
over labelled pages, gathered by Spark. Pages label themselves: those with an article or main
element, whose inside is content except for what its markup names as something else.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Labelled pages that the potentials are counted on, about.
TRAIN_PAGES = 2_000
#: Count given to what was never seen, and weight of all kinds in the estimate for one.
SMOOTH, BACK = 0.5, 4.0
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'](?=[^>]*>))*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd label link "
    "map mark meta q rp rt ruby s samp small source span strike strong sub sup time track tt u var "
    "wbr".split())
#: What an opening tag closes while it is the current block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
TAGS = ("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th "
        "tbody thead blockquote pre figure figcaption nav header footer aside form fieldset address "
        "details summary menu dialog head center hr").split()
_BAD = re.compile(r"(?:^|[^a-z])(?:nav|navbar|navigation|menu|foot|footer|masthead|topbar|side|sidebar|aside|"
                  r"ad|ads|advert\w*|adsense|sponsor\w*|banner|promo\w*|cookie\w*|consent|notice|alert|popup|modal|"
                  r"newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|"
                  r"comment|comments|reply|replies|disqus|breadcrumb\w*|pagination|pager|widget|copyright|"
                  r"toolbar|skip|hidden|form|contentinfo|complementary|search)(?:$|[^a-z])")
_GOOD = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|main|post|entry|story|body|text|prose)(?:$|[^a-z])")
NOT_CONTENT = frozenset("nav footer aside form menu dialog fieldset head".split())
SKIP = frozenset(("head",))


class Page:
    """Nodes of a page in document order (parents first), and its text runs with their node."""

    def __init__(self, text: str):
        self.tag, self.parent, self.names, self.chars, self.linked = ["#"], [-1], [""], [0], [0]
        self.runs: list[tuple[int, str]] = []
        stack, inline, links = [0], [], 0
        run: list[str] = []
        at, n, low = 0, len(text), None

        def add(piece: str) -> None:
            run.append(piece)
            if links:
                self.linked[stack[-1]] += len(piece.strip())

        def flush() -> None:
            if run:
                words = " ".join("".join(run).split())
                run.clear()
                if words:
                    self.runs.append((stack[-1], words))
                    self.chars[stack[-1]] += len(words)

        while at < n:
            open_at = text.find("<", at)
            if open_at < 0:
                add(entities.unescape(text[at:]))
                break
            m = _TAG.match(text, open_at)
            if open_at > at:
                add(entities.unescape(text[at:open_at]))
            if not m:
                add("<")
                at = open_at + 1
                continue
            at = m.end()
            if m.group(2) is None:
                continue
            closing, tag = m.group(1), m.group(2).lower()
            if closing:
                if tag in INLINE:
                    if tag == "a":
                        links = max(0, links - 1)
                    if tag == "br":
                        add(" ")
                    continue
                flush()
                links = 0
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == tag:
                        del stack[depth:]
                        break
                continue
            if tag in RAW:
                if not m.group(3).endswith("/") or tag in ("script", "style", "textarea", "title"):
                    low = text.lower() if low is None else low
                    if len(low) != n:  # a letter whose lower case is longer
                        low = re.sub("[A-Z]", lambda x: x.group().lower(), text)
                    end = low.find(f"</{tag}", at)
                    at = n if end < 0 else n if (gt := text.find(">", end)) < 0 else gt + 1
                continue
            if tag in INLINE:
                if tag == "a":
                    links += 1
                elif tag == "br":
                    add(" ")
                continue
            flush()
            links = 0
            if tag in CLOSES:
                while len(stack) > 1 and self.tag[stack[-1]] in CLOSES[tag] | {"p"}:
                    stack.pop()
            elif self.tag[stack[-1]] == "p":
                stack.pop()
            if tag in VOID:
                continue
            names = " ".join(k.lower() if k.lower() == "hidden" else (a or b or c or "")
                             for k, a, b, c in _ATTR.findall(m.group(3))) if m.group(3) else ""
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.names.append(re.sub("(?<=[a-z])(?=[A-Z])", "-", names).lower() if names else "")
            self.chars.append(0)
            self.linked.append(0)
            stack.append(len(self.tag) - 1)
        flush()

    def labels(self) -> list[int] | None:
        """1 for content, from the page's own markup; None if it doesn't say."""
        inside = [0] * len(self.tag)
        said = False
        for i in range(1, len(self.tag)):
            up = inside[self.parent[i]]
            tag, names = self.tag[i], self.names[i]
            if up == 2 or tag in NOT_CONTENT or (_BAD.search(names) and not _GOOD.search(names)):
                inside[i] = 2 if up else 0
            elif tag in ("article", "main") or "articlebody" in names or "role=main" in names:
                inside[i], said = 1, True
            else:
                inside[i] = up
        return [int(x == 1) for x in inside] if said else None

    def evidence(self) -> list[tuple[str, ...]]:
        """What each node shows, as features."""
        total, linked, inner = self.chars[:], self.linked[:], [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        found = []
        for i, tag in enumerate(self.tag):
            names, own = self.names[i], self.chars[i]
            words = ("bad" if _BAD.search(names) else "") + ("good" if _GOOD.search(names) else "") if names else "none"
            size = 0 if not own else 1 if own < 25 else 2 if own < 100 else 3
            density = 0 if not total[i] else 1 + min(3, int(4 * linked[i] / max(total[i], 1)))
            found.append((f"names {words}", f"size {size}", f"links {density}"))
        return found


def kind(tag: str) -> str:
    return tag if tag in _KNOWN else "other"


_KNOWN = frozenset(TAGS)


def _potential_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for b in batch.column(0).to_pylist():
            page = Page(b.decode("utf-8", "replace"))
            y = page.labels()
            if y is None:
                continue
            for i, shown in enumerate(page.evidence()):
                if i:
                    counts["edge", kind(page.tag[i]), y[page.parent[i]], y[i]] += 1
                for feature in shown:
                    counts[feature, kind(page.tag[i]), -1, y[i]] += 1
        keys = list(counts)
        types = (pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], t) for i, t in enumerate(types)),
             pa.array([counts[k] for k in keys], pa.int64())],
            ["name", "tag", "parent", "label", "n"])


#: Pages of our own: an article with what usually surrounds it, with and without telling names.
EXAMPLES = tuple(f"""<body><div class="{top}"><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div>
<article><h1>A title of some words</h1><p>{"A sentence of the text of this page, long enough for a paragraph. " * 3}</p>
<h2>A part</h2><p>{"More of it follows here, in plain words. " * 2}</p><ul><li>One thing in a list</li><li>Another</li></ul>
<table><tr><td>Cell</td><td>12</td></tr></table><blockquote><p>{"Someone said it. " * 4}</p></blockquote></article>
<div class="{side}"><h3>See also</h3><ul><li><a href=z>Other page</a></li></ul><p>Short note</p></div>
<div class="{end}"><p><a href=i>Imprint</a> <a href=p>Privacy</a></p><p>All rights reserved</p></div></body>"""
                 for top, side, end in (("nav", "sidebar", "footer"), ("a", "b", "c"), ("menu", "related", "copyright")))


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> dict:
    """Potentials from about TRAIN_PAGES pages that label themselves, chosen by a hash of their id.

    The counts are over a fixed set of names and kinds, so what comes to the driver is bounded. A few
    pages of our own (EXAMPLES) are counted besides, so that there are potentials where no page has labels.
    """
    spark = pages.sparkSession
    labelled = pages.where(F.col(html).rlike(r"(?i)<(article|main)[\s>/]|articlebody|role\s*=\s*[\"']?main"))
    n = labelled.count()
    edge = (1 << 63) - 1 if n <= TRAIN_PAGES else int((TRAIN_PAGES / n - 0.5) * 2.0 ** 64)
    some = labelled.where(F.xxhash64(F.coalesce(F.col(page_id).cast("string"), F.lit(""))) <= edge).select(
        html).union(spark.createDataFrame([(e,) for e in EXAMPLES], f"{html} string"))
    some = some.select(F.coalesce(F.col(html), F.lit("")).cast("binary").alias("html"))
    rows = some.mapInArrow(
        _potential_counts, "name string, tag string, parent int, label int, n long").groupBy(
        "name", "tag", "parent", "label").agg(F.sum("n").alias("n")).collect()
    counts = Counter({(r["name"], r["tag"], r["parent"], r["label"]): r["n"] for r in rows})
    every = Counter()  # over all kinds
    for (name, _, parent, y), n in counts.items():
        every[name, parent, y] += n
    nodes = Counter()  # by kind and label; every node shows one size
    for (name, tag, parent, y), n in counts.items():
        if name.startswith("size "):
            nodes[tag, y] += n
            nodes[None, y] += n
    model: dict = {"emit": {}, "edge": {}}
    for tag in _KNOWN | {"other"}:
        for name in {k[0] for k in counts if k[0] != "edge"}:
            model["emit"][name, tag] = tuple(
                (counts[name, tag, -1, y] + BACK * (every[name, -1, y] + SMOOTH) / (nodes[None, y] + 10 * SMOOTH))
                / (nodes[tag, y] + BACK) for y in (0, 1))
        edge = []
        for up in (0, 1):
            total = every["edge", up, 0] + every["edge", up, 1] + 2 * SMOOTH
            c = [counts["edge", tag, up, y] + BACK * (every["edge", up, y] + SMOOTH) / total for y in (0, 1)]
            edge.append((c[0] / sum(c), c[1] / sum(c)))
        model["edge"][tag] = tuple(edge)
    return model


_EVEN_EDGE = ((0.9, 0.1), (0.1, 0.9))


def marginals(page: Page, model: dict) -> list[float]:
    """Probability of content for every node, by messages up the tree and down again."""
    n, parent = len(page.tag), page.parent
    emit, edge = model["emit"], model["edge"]
    up = []
    for tag, shown in zip(page.tag, page.evidence()):
        a = b = 1.0
        for feature in shown:
            e = emit.get((feature, kind(tag)))
            if e:
                a, b = a * e[0], b * e[1]
        s = a + b
        up.append([a / s, b / s])
    message = [(1.0, 1.0)] * n
    potential = [edge.get(kind(t), _EVEN_EDGE) for t in page.tag]
    for i in range(n - 1, 0, -1):
        a, b = up[i]
        (p00, p01), (p10, p11) = potential[i]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
        s = m0 + m1
        message[i] = (m0 / s, m1 / s)
        u = up[parent[i]]
        x, y = u[0] * message[i][0], u[1] * message[i][1]
        s = x + y
        u[0], u[1] = x / s, y / s
    belief = [(0.0, 0.0)] * n
    belief[0] = (0.99 * up[0][0], 0.01 * up[0][1])
    for i in range(n):
        if i:
            p = belief[parent[i]]
            o0, o1 = p[0] / max(message[i][0], 1e-300), p[1] / max(message[i][1], 1e-300)
            (p00, p01), (p10, p11) = potential[i]
            s = o0 + o1
            o0, o1 = o0 / s, o1 / s
            belief[i] = (up[i][0] * (o0 * p00 + o1 * p10), up[i][1] * (o0 * p01 + o1 * p11))
        s = belief[i][0] + belief[i][1]
        belief[i] = (belief[i][0] / s, belief[i][1] / s)
    return [b[1] for b in belief]


def page_text(text: str, model: dict) -> str:
    page = Page(text)
    if not page.runs:
        return ""
    content = marginals(page, model)
    hidden = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        hidden[i] = hidden[page.parent[i]] or page.tag[i] in SKIP
    return "\n".join(words for node, words in page.runs if content[node] > 0.5 and not hidden[node])


def extract_text(pages: DataFrame, model: dict, html: str = "html",
                 keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in ``keep`` and text of every page's whole html; empty if there is none.

    Null html is empty. Rows are independent, so repeats stay repeats; other columns are ignored.
    """
    def work(pages_):
        return [[page_text(b.decode("utf-8", "replace"), model) for b in pages_]]

    return map_texts(pages, html, keep, work, "text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    found = extract_text(pages, train(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))
