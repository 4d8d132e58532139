"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text at block-level tags. Each block has its words, its link density (share of words inside links), the same two figures of the blocks
before and after it, and what the tags around it say. A decision tree, trained on a small table of labelled pages, says which blocks are main text. The tree
becomes a column expression, so pages are parsed once, in their own row, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

# Element names and attribute values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("template noscript svg object audio video canvas select datalist button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that ends when one of the first kind begins, unless one of the second lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ASIDE = frozenset("nav aside footer dialog menu search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status note".split())
# Words of class and id names that pages use for what is not their main text, for their main text, and for layouts that hold both.
ASIDE_NAMES = frozenset("""ad ads advert adverts advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright discussion disqus
footer gdpr legal login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion promotions recommended
recommendations related replies reply respond responses share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola teaser teasers toolbar widget widgets""".split())
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
LAYOUT_NAMES = frozenset("has layout no page wrapper with without".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading")


class Around(NamedTuple):
    """What the open elements say: 3 inside an article, 2 inside the main element, 1 inside something named like it; not main text, for good or only until an article or main element begins;
    inside a link; not shown; marked as main text in a labelled page."""

    name: str
    block: bool
    level: int = 0
    aside: bool = False
    soft: bool = False
    link: bool = False
    unseen: bool = False
    marked: bool = False


class Block(NamedTuple):
    text: str
    words: int
    density: float
    level: int
    aside: bool
    heading: bool
    marked: bool


def _names(value: str) -> Iterator[set[str]]:
    """The parts of each name in a class or id attribute."""
    for name in value.split():
        yield {p.lower() for p in NAME_PART.findall(name)}


def _inside(name: str, attributes: str, outer: Around) -> Around:
    """What holds inside an element that begins within ``outer``."""
    block = name in BLOCK
    own = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    level, aside, soft = 0, name in ASIDE, name == "form" or name == "header" and outer.level < 2
    role = own.get("role", "").lower()
    if name == "article" or role == "article" or own.get("itemprop") == "articleBody":
        level = 3
        aside |= outer.level == 3 and name == "article"  # an article within an article is a reader's comment or another page's teaser
    elif name == "main" or role == "main":
        level = 2
    aside |= role in ASIDE_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) is not None
    if name not in ("html", "body"):
        for parts in _names(f"{own.get('class', '')} {own.get('id', '')}"):
            if parts & LAYOUT_NAMES:
                continue
            aside |= bool(parts & ASIDE_NAMES)
            soft |= "header" in parts and outer.level < 2
            if block and parts & MAIN_NAMES:
                level = max(level, 1)
    if level >= 2 and not aside:
        soft = False
    else:
        soft |= outer.soft
    return Around(name, block, max(level, outer.level), aside or outer.aside, soft, name == "a" or outer.link, name in UNSEEN or outer.unseen, own["data-main"] != "no" if "data-main" in own else outer.marked)


class _Page:
    """One pass over the tags of a page."""

    def __init__(self) -> None:
        self.open = [Around("", True)]
        self.names: Counter[str] = Counter()
        self.found: list[Block] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.breaks = 0
        self.articles = 0
        self.heading = False
        self.at = self.open[0]

    def text(self, piece: str) -> None:
        around = self.open[-1]
        if around.unseen or not piece:
            return
        piece = unescape(piece)
        words = len(piece.split())
        if words:
            if not any(p.strip() for p in self.pieces):
                self.at, self.heading = around, any(x.name in HEADINGS for x in self.open[-4:])
            self.breaks = 0
            self.linked += words * around.link
        self.pieces.append(piece)

    def flush(self) -> None:
        words = "".join(self.pieces).split()
        if words:
            self.found.append(Block(" ".join(words), len(words), min(1.0, self.linked / len(words)), self.at.level, self.at.aside or self.at.soft, self.heading, self.at.marked))
        self.pieces, self.linked, self.breaks = [], 0, 0

    def close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.names[self.open.pop().name] -= 1

    def begin(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            self.pieces.append(" ")
            return
        if name in BLOCK:
            self.flush()
            depth = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].block)
            if self.open[depth].name == "p":
                self.close(depth)
        elif name in ("td", "th"):
            self.pieces.append(" ")
        if name in ENDS:
            ended, border = ENDS[name]
            if any(self.names[x] for x in ended):
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i].name in ended:
                        self.close(i)
                        break
                    if self.open[i].name in border:
                        break
        elif name == "a" and self.names["a"]:
            self.end("a")
        if name not in VOID:
            self.articles += name == "article"
            self.open.append(_inside(name, attributes, self.open[-1]))
            self.names[name] += 1

    def end(self, name: str) -> None:
        block = name in BLOCK
        if block:
            self.flush()
        if not self.names[name]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == name:
                self.close(i)
                return
            if not block and self.open[i].block:  # an inline end tag ends no block
                return


def blocks(html: str | None) -> tuple[list[Block], int]:
    """Text blocks of a page in page order, and the number of its article elements. Markup need not be well formed; null is an empty page."""
    html = html or ""
    page, at = _Page(), 0
    while True:
        m = TOKEN.search(html, at)
        page.text(html[at:m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        if not m[1]:
            continue
        name = m[1].lower()
        if html[m.start() + 1] == "/":
            page.end(name)
        elif name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = closing.end() if closing else len(html)
        else:
            page.begin(name, m[2])
    page.flush()
    return page.found, page.articles


def main_level(found: list[Block], articles: int) -> int:
    """The level from which blocks count as being inside the page's main element; 0 if it has none."""
    words = [sum(b.words for b in found if b.level >= n and not b.aside) for n in range(4)]
    if words[3] and (articles < 2 or 2 * words[3] >= words[2]):
        return 3
    if words[2]:
        return 2
    return int(words[1] > 0 and 2 * words[1] >= words[0])


def described(html: str | None) -> list[dict]:
    """Blocks of a page with their features. ``place``: 2 inside the page's main element, 1 if it has none, 0 outside of it or in a part that its tags name otherwise."""
    found, articles = blocks(html)
    top = main_level(found, articles)
    out = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        figures = (b.words, b.density, before.words if before else 0, before.density if before else 0.0, after.words if after else 0, after.density if after else 0.0,
                   0 if b.aside or b.level < top else 1 + (top > 0), b.heading)
        out.append({"text": b.text, "features": [float(x) for x in figures], "label": float(b.marked)})
    return out


def with_blocks(df: DataFrame, html: str = "html", name: str = "blocks") -> DataFrame:
    """Replaces a column of pages by their described blocks (``text``, ``features``, ``label``) in ``name``; a column of that name is replaced too."""
    df = df.drop(name) if name != html else df
    one = StructType().add("text", StringType()).add("features", ArrayType(DoubleType())).add("label", DoubleType())
    rest = [f for f in df.schema if f.name != html]
    kinds = StructType([*rest, *StructType().add(name, ArrayType(one))])
    listed = pa.list_(pa.struct([("text", pa.string()), ("features", pa.list_(pa.float64())), ("label", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):  # blocks are larger than the page they come from
                few = b.slice(lo, 64)
                made = pa.array([described(p) for p in few.column(html).to_pylist()], listed)
                yield pa.RecordBatch.from_arrays([*(few.column(f.name) for f in rest), made], [*(f.name for f in rest), name])

    return df.mapInArrow(run, kinds)


# ---------------------------------------------------------------- labelled pages and the tree

#: Small labelled pages. A number in braces stands for so many words; ``data-main`` marks the main text, ``data-main=no`` what is none within it.
LABELLED = (
    "<nav><ul><li><a href=/>{1}</a><li><a href=/>{2}</a><li><a href=/>{1}</a></ul></nav><article data-main><h1>{6}</h1><p>{50}<p>{8}<p>{90}<p><a href=/>{4}</a><p>{20} <a href=/>{3}</a></article><footer>{9}</footer>",
    "<header><p>{4}</p><p><a href=/>{2}</a></p></header><main data-main><h1>{5}</h1><p>{40}</p><h2>{3}</h2><p>{60}</p><ul><li>{4}</li><li>{12}</li><li><a href=/>{3}</a></li></ul><p>{2}</p></main><footer><p>{20}</p><p>{12}</p></footer>",
    "<div class=menu><a href=/>{1}</a> <a href=/>{1}</a> <a href=/>{2}</a></div><div class=cookie-notice><p>{25} <a href=/>{2}</a></p></div><article data-main><h1>{9}</h1><p>{3}</p><p>{120}</p><blockquote>{30}</blockquote></article><section id=comments><h3>{2}</h3><p>{45}</p><p>{80}</p></section><footer>{30}</footer>",
    "<header>{3}</header><div><article data-main><h1>{4}</h1><p>{25}</p><div class=ad data-main=no>{18}</div><p>{35}</p></article><aside><h3>{2}</h3><p>{40}</p><ul><li><a href=/>{6}</a></li></ul></aside></div>",
    "<article><header><h1 data-main>{7}</h1></header><p data-main>{1}</p><p data-main>{70} <a href=/>{8}</a> {5}</p><form><p>{22}</p></form><p data-main>{16}</p><footer>{14}</footer></article><p>{50}</p><p>{9}</p>",
    "<p>{30}</p><main><h1 data-main>{3}</h1><p data-main>{10}</p><p data-main><a href=/>{12}</a></p><div class=related><p>{60}</p></div></main><p>{45}</p><p><a href=/>{3}</a></p>",
    "<div id=nav><a href=/>{2}</a></div><div id=content data-main><h2>{5}</h2><p>{44}</p><p>{6}</p><p><a href=/>{2}</a></p></div><div id=footer>{12}</div><p>{7}</p>",
    "<div><a href=/>{1}</a> <a href=/>{1}</a></div><div><a href=/>{3}</a></div><h1 data-main>{7}</h1><p data-main>{60}</p><p data-main>{9}</p><p data-main>{75} <a href=/>{2}</a></p><p data-main>{30} <a href=/>{12}</a> {9}</p><div><a href=/>{2}</a> <a href=/>{1}</a></div><div>{6} <a href=/>{1}</a></div>",
    "<table><tr><td><a href=/>{2}</a></td></tr><tr><td><a href=/>{1}</a></td></tr></table><h1 data-main>{4}</h1><p data-main>{35} <a href=/>{5}</a></p><p data-main>{90} <a href=/>{20}</a></p><p data-main>{4}</p><p data-main>{50}</p><p><a href=/>{4}</a></p><p>{8}</p>",
    "<ul><li><a href=/>{1}</a></li><li><a href=/>{2}</a></li></ul><div>{5}</div><div>{3} <a href=/>{6}</a></div><h1 data-main>{10}</h1><div data-main>{28}</div><div data-main>{95}</div><ul data-main><li>{11}</li><li>{14}</li></ul><div data-main>{41}</div><div><a href=/>{8}</a></div><div><a href=/>{7}</a></div><div>{4}</div>",
    "<p><a href=/>{1}</a></p><h2 data-main>{6}</h2><p data-main>{15}</p><p data-main>{22}</p><p data-main>{130}</p><p>{5} <a href=/>{9}</a></p><h3><a href=/>{5}</a></h3><p><a href=/>{10}</a></p><p>{3}</p>",
    "<div>{2}</div><div><a href=/>{2}</a></div><div><a href=/>{1}</a></div><h1 data-main>{8}</h1><p data-main>{33}</p><h2 data-main>{2}</h2><p data-main>{14} <a href=/>{6}</a> {20} <a href=/>{7}</a></p><h2 data-main>{4}</h2><p data-main>{58}</p><p>{2} <a href=/>{5}</a></p><p>{6}</p>",
    "<p data-main>{200}</p><p data-main>{150}</p><p data-main>{12}</p><p data-main>{90}</p>",
    "<h1 data-main>{3}</h1><p data-main>{18}</p><p data-main>{26}</p>",
    "<nav><a href=/>{1}</a></nav><p data-main>{26}</p><p data-main>{17}</p><footer>{40}</footer>",
    "<nav><a href=/>{1}</a></nav><article data-main><p>{2}</p></article><footer>{9}</footer>",
    "<article data-main>{3}</article>",
    "<main data-main>" + "<p>{2}</p><p><a href=/>{3}</a></p><p>{5} <a href=/>{9}</a></p><p>{4} <a href=/>{9}</a></p><p>{1}</p><p><a href=/>{14}</a></p><p>{7}</p>" * 6 + "</main>",
    "<p>{40}</p><p>{25}</p><div>{18}</div><div>{4}</div><article data-main><p>{30}</p><p>{24}</p></article><p>{80}</p><p>{60}</p><div>{3}</div><p>{25}</p>",
    "<div>{6}</div><div>{14}</div><main data-main><p>{50}</p></main><div>{35}</div><div>{70}</div><p>{12}</p><p>{20} <a href=/>{1}</a></p>",
    "<nav><a href=/>{1}</a></nav><article data-main><p>{20} <a href=/>{3}</a></p><p>{9}</p></article>",
    "<nav><a href=/>{1}</a></nav><main data-main><p>{2} <a href=/>{3}</a></p><p>{3}</p></main>",
    "<article data-main><p>{40}</p><p><a href=/>{4}</a></p><p>{15}</p></article>",
    "<footer><a href=/>{4}</a></footer><div class=article data-main><p>{12} <a href=/>{2}</a></p><p>{60}</p></div>",
    "<article data-main><h1>{2}</h1><p>{1}</p><p>{3}</p><ul><li>{1}</li><li>{2}</li></ul></article>",
    "<p>{3}</p><article data-main><p>{3}</p><p><a href=/>{2}</a></p><p>{5}</p><p>{2} <a href=/>{3}</a></p></article><p><a href=/>{2}</a></p><p>{70}</p>",
    "<ul><li><a href=/>{3}</a></li></ul><main data-main><table><tr><td>{1}</td><td>{1}</td></tr><tr><td><a href=/>{1}</a></td></tr></table><p>{6} <a href=/>{1}</a></p></main><div>{15}</div><div><a href=/>{1}</a></div>",
    "<div class=content data-main><h1>{4}</h1><p>{7}</p><p><a href=/>{5}</a></p><p>{3}</p></div><div class=comments><p>{4}</p><p>{90}</p></div>",
    "<div class=header>{4}</div><div><a href=/>{1}</a></div><div id=main-nav>{1}</div><div class=post data-main><p>{30}</p><p>{1}</p><p>{55}</p></div><div class=share><a href=/>{1}</a></div>",
    "<header><h1>{3}</h1><p>{18}</p></header><nav><h2>{1}</h2><p>{30}</p></nav><p data-main>{34}</p><p data-main>{51}</p><aside><p>{66}</p><p>{33}</p></aside><footer>{44}</footer>",
    "<div><a href=/>{12}</a></div><div><a href=/>{14}</a></div><div><a href=/>{11}</a></div><div>{3}</div>",
)


def labelled_pages(spark: SparkSession) -> DataFrame:
    """The labelled pages as a table with the column ``html``."""
    fill = [re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), p) for p in LABELLED]
    return spark.createDataFrame(pd.DataFrame({"html": fill}), "html string")


def train(labelled: DataFrame, html: str = "html", depth: int = 8) -> DecisionTreeClassificationModel:
    """Decision tree over the blocks of labelled pages, a table that is small by its nature: people mark it, with ``data-main`` on elements of the main text."""
    rows = with_blocks(labelled.select(html), html).select(F.explode("blocks").alias("b")).select(array_to_vector("b.features").alias("features"), "b.label")
    return DecisionTreeClassifier(maxDepth=depth, maxBins=256, seed=1).fit(rows)


def rule(model: DecisionTreeClassificationModel, features: Column) -> Column:
    """The tree as a condition on an array of features."""
    lines = [x.strip() for x in model.toDebugString.split("\n")[1:] if x.strip()]

    def node() -> Column:
        line = lines.pop(0)
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]) == 1.0)
        feature, bound = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        lines.pop(0)  # the other branch
        return F.when(features[int(feature)] <= float(bound), low).otherwise(node())

    return node()


def main_text(df: DataFrame, model: DecisionTreeClassificationModel, html: str = "html", text: str = "text", count: str = "n_chars") -> DataFrame:
    """Adds the main text of each page, its blocks joined by line breaks, and its number of code points; columns of these names are replaced.

    Character references are decoded and white space within a block becomes one blank. A null, empty or textless page gives an empty text; pages of any length are read whole;
    repeated rows are rows of their own; an empty table gives an empty one. The column of pages is dropped.
    """
    found = with_blocks(df.drop(*({text, count} - {html})), html, "__blocks")
    kept = F.filter("__blocks", lambda b: rule(model, b["features"]))
    return found.withColumn(text, F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).withColumn(count, F.length(text).cast("long")).drop("__blocks")
