"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each has its word count and link density, those of the two blocks before
and the two after it, and what encloses it: elements and names are features among others. A decision tree, trained with
Spark ML on a small labelled table of blocks, says which blocks are the article.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from stillkeep.llm.common import table

# HTML element names by role.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "select", "annotation", "annotation-xml")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt msub msubsup msup "
    "mtext munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav footer aside form menu dialog button fieldset".split())
ARTICLE = frozenset(("article", "main"))
NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navigation navbar breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments respond reply replies disqus discussion share sharing social related recommended widget widgets tags pagination pager skip search".split()
)
#: Words that say what of a named part something is; a name made of these and NAMES alone is a part of that kind.
PARTS = frozenset("area bar block body bottom box button buttons col column container content footer group header inner items left link links list main outer panel right section site top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments respond reply replies disqus discussion".split())
_SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_ROLE = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|alertdialog|menu|menubar|toolbar)$", re.I)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HEADING = re.compile(r"h[1-6]$")


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    heading: bool
    item: bool
    article: int  # 1 inside an article or main element
    chrome: int  # 1 inside navigation, footers, forms or hidden parts by their elements
    named: int  # 1 inside parts that are named like adverts, sidebars or comments


def _is_name(name: str, of: frozenset[str] = NAMES) -> bool:
    """Whether a class or id says that a part is one of NAMES: "ad-box" and "cookie_notice2" do, "share-price" does not."""
    words = [w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()]
    return any(w in of for w in words) and all(w in NAMES or w in PARTS for w in words)


def _kind(tag: str, attributes: str, in_article: bool) -> tuple[int, int]:
    """(whether the element itself is no part of an article, whether its names say so)."""
    chrome = tag in CHROME or tag == "header" and not in_article
    if "=" not in attributes:
        return int(chrome or bool(re.search(r"\shidden\b", attributes))), 0
    own = {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
    if tag in ("body", "html"):
        return 0, 0
    names = f"{own.get('class', '')} {own.get('id', '')}".split()
    named = any(_is_name(n, COMMENTS if tag in ARTICLE else NAMES) for n in names)
    hidden = (
        _ROLE.match(own.get("role", ""))
        or _HIDDEN.search(own.get("style", ""))
        or own.get("aria-hidden", "").lower() == "true"
        or re.search(r"\shidden(?:\s|=|$)", attributes)
    )
    return int(chrome or bool(hidden)), int(named)


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order; blocks without words are left out."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    breaks = 0
    stack: list[tuple[str, int, int, int]] = []  # tag, whether it is an article, chrome, named
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    article = chrome = named = 0
    heading = item = False

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(n, linked), heading, item, int(article > 0), int(chrome > 0), int(named > 0)))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked, breaks
        if text:
            parts.append(text)
            if in_link:
                linked += len(html_lib.unescape(text).split())
            if not text.isspace():
                breaks = 0

    def pop() -> str:
        nonlocal article, chrome, named
        tag, a, c, m = stack.pop()
        article, chrome, named = article - a, chrome - c, named - m
        opened[tag] -= 1
        return tag

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not ends
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                close()
            continue
        if tag not in INLINE:
            close()
            breaks = 0
            heading = not ends and bool(_HEADING.match(tag))
            item = not ends and tag in ("li", "dt", "dd", "td", "th")
            if tag != "a":
                in_link = in_link and tag not in ("p", "div", "li", "nav", "ul", "article", "footer")
        if tag in VOID:
            continue
        if ends:
            if opened.get(tag):
                while pop() != tag:
                    pass
        elif tag not in INLINE or attributes:
            a = int(tag in ARTICLE)
            c, m = _kind(tag, attributes, article > 0)
            if (c or m) and tag in INLINE:
                close()
            if tag in ("p", "li", "td", "tr", "dt", "dd", "option"):  # these end an open one of their kind
                limit = ("p",) if tag == "p" else (tag, "p")
                while stack and (stack[-1][0] in limit or stack[-1][0] in INLINE):
                    pop()
            stack.append((tag, a, c, m))
            opened[tag] = opened.get(tag, 0) + 1
            article, chrome, named = article + a, chrome + c, named + m
    close()
    return out


FEATURES = (
    "words", "links", "words before", "links before", "words after", "links after", "words 2 before", "links 2 before", "words 2 after", "links 2 after",
    "sentence", "heading", "item", "article", "chrome", "named", "page has article",
)
_SENTENCE = re.compile(r"[.!?:…。！？][\"'»”’)\]]*$")


def features_of(blocks: list[Block]) -> list[list[float]]:
    """A row of FEATURES for each block; beyond either end of the page there are no words and no links."""
    at = [(0.0, 0.0)] * 2 + [(float(b.words), b.linked / b.words) for b in blocks] + [(0.0, 0.0)] * 2
    has = float(any(b.article and not b.chrome and not b.named for b in blocks))
    rows = []
    for k, b in enumerate(blocks, 2):
        own = (b.heading, b.item, b.article, b.chrome, b.named)
        ends = bool(_SENTENCE.search(b.text[-8:]))
        rows.append([*at[k], *at[k - 1], *at[k + 1], *at[k - 2], *at[k + 2], float(ends), *map(float, own), has])
    return rows


def _words(n: int, start: int = 0) -> str:
    return " ".join(("river stone light morning window garden letter market winter road".split())[(start + k) % 10] for k in range(n)).capitalize()


def _said(n: int) -> str:
    return _words(n) + "."


Piece = tuple[str, list[tuple[str, int]]]  # markup; its blocks, each with 1 if it is a part of the article


def _p(n: int, label: int, tag: str = "p") -> Piece:
    return f"<{tag}>{_said(n)}</{tag}>", [(_said(n), label)]


def _linked(n: int, links: int, label: int, end: str = ".", tag: str = "p") -> Piece:
    """A paragraph that ends in a link of so many words."""
    link = _words(links, 3)
    return f'<{tag}>{_words(n)} <a href="/x">{link}</a>{end}</{tag}>', [(f"{_words(n)} {link}{end}".strip(), label)]


def _list(n: int, label: int, linked: bool = True, size: int = 3, tag: str = "li") -> Piece:
    rows = [_words(size + k % 3, k) for k in range(n)]
    inner = "".join(f'<{tag}><a href="/{k}">{r}</a></{tag}>' if linked else f"<{tag}>{r}</{tag}>" for k, r in enumerate(rows))
    outer = {"li": "ul", "td": "tr", "p": "div"}[tag]
    return f"<{outer}>{inner}</{outer}>", [(r, label) for r in rows]


def _in(open_tag: str, *pieces: Piece, label: int | None = None) -> Piece:
    tag = open_tag.split()[0]
    blocks = [(t, x if label is None else label) for _, own in pieces for t, x in own]
    return f"<{open_tag}>{''.join(m for m, _ in pieces)}</{tag}>", blocks


def _head(n: int, label: int, tag: str = "h1") -> Piece:
    return f"<{tag}>{_words(n)}</{tag}>", [(_words(n), label)]


def labelled_pages(pages: int = 400, seed: int = 5) -> Iterator[Piece]:
    """The labelled table: small pages by rule, each block with 1 if it is a part of the article.

    In a third of them an article element holds it, and paragraphs, lists and adverts stand outside and named parts inside. In a
    fifth only names tell some parts. In the others no element or name tells: there are bars and lists of links, short lines
    beside them, and text with links in it and with headings, lists and short paragraphs between.
    """
    rng = random.Random(seed)

    def size() -> int:
        return int(2 ** rng.uniform(0, 7.5))

    def links(label: int = 0) -> Piece:
        return _list(rng.randint(3, 7), label, size=rng.choice([1, 1, 2, 3, 6, 9]), tag=rng.choice(["li", "li", "p", "td"]))

    def bar() -> Piece:
        names = [_words(1, k) for k in range(rng.randint(2, 5))]
        return "<p>" + " | ".join(f'<a href="/{n}">{n}</a>' for n in names) + "</p>", [(" | ".join(names), 0)]

    def aside_line() -> Piece:
        return rng.choice([_head(rng.randint(1, 3), 0, "h3"), (f"<div>{_words(2)}</div>", [(_words(2), 0)])])

    def body(bare: bool) -> list[Piece]:
        """Title and text; where nothing else tells, short parts stand between longer paragraphs."""
        least = 14 if bare else 1
        title = [_head(rng.randint(2, 12), 1), _linked(0, rng.randint(2, 12), 1, "", "h1")][not bare and rng.random() < 0.3]
        out = [title] if rng.random() < 0.8 else []
        for _ in range(rng.randint(2 if bare else 1, 6)):
            kind = rng.random()
            if kind < 0.15:
                out.append(_head(rng.randint(1, 5), 1, "h2"))
            elif kind < 0.25:
                out.append(_list(rng.randint(2, 4), 1, False, rng.randint(2, 9)))
            elif kind < 0.4:
                out.append(_p(rng.randint(1, 8), 1))
            elif kind < 0.5:
                out.append(_linked(max(least, size()), rng.randint(1, 5), 1))
            elif kind < 0.6 and not bare:
                out.append(_linked(0, rng.randint(2, 9), 1, rng.choice([".", ""])))
            out.append(_p(max(least, size()), 1))
        return out

    def outside() -> list[Piece]:
        made = (
            lambda: _in("nav", links()), lambda: links(), lambda: bar(), lambda: _p(size(), 0), lambda: _p(size(), 0, "div"), lambda: aside_line(),
            lambda: _in('div class="ad"', _p(size(), 0)), lambda: _in("aside", _p(size(), 0)), lambda: _in("footer", _p(size(), 0)), lambda: _in("form", _p(9, 0)),
        )
        return [rng.choice(made)() for _ in range(rng.randint(0, 4))]

    def named() -> Piece:
        name = rng.choice(["ad", "ad-box", "promo", "related", "share-buttons", "newsletter", "comments", "sidebar", "cookie-notice"])
        return _in(f'div class="{name}"', *rng.choice([[_p(size(), 0)], [_head(1, 0, "h3"), _p(size(), 0), _p(size(), 0)], [links()]]))

    for k in range(pages):
        if k % 3 == 0:
            inner = body(False)
            if rng.random() < 0.5:
                inner.insert(rng.randint(0, len(inner)), named())
            if rng.random() < 0.3:
                inner.append(links())  # a menu at the article's end
            yield _in("body", *outside(), _in(rng.choice(["article", "main"]), *inner), *outside())
        elif k % 12 == 2:  # a page of a few short texts and nothing else
            yield _in("body", *(rng.choice([_p(n, 1), _head(n, 1, "p")]) for n in rng.choices(range(1, 9), k=rng.randint(1, 4))))
        elif k % 3 == 1 and k % 2:
            yield _in("body", _in('div class="navbar"', links()), named(), _in('div class="content"', *body(True)), named(), _in("footer", _p(size(), 0)))
        else:
            top = rng.choice([[], [bar()], [links()], [links(), aside_line(), links()], [bar(), links()], [_linked(1, 4, 0)]])
            end = rng.choice([[], [bar()], [links()], [aside_line(), links()], [links(), bar()], [_linked(2, 6, 0), links()]])
            yield _in("body", *top, *body(True), *end)


def labelled_blocks() -> list[tuple[list[float], float]]:
    rows = []
    for page, wanted in labelled_pages():
        blocks = blocks_of(page)
        if [b.text for b in blocks] != [t for t, _ in wanted]:
            raise ValueError(f"labelled blocks that the page does not have: {page[:200]}")
        rows += [(x, float(label)) for x, (_, label) in zip(features_of(blocks), wanted, strict=True)]
    return rows


Tree = float | tuple[int, float, "Tree", "Tree"]


@functools.cache
def trained_tree() -> Tree:
    """The decision tree as nested (feature, threshold, at most, above), trained once in a driver process."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(Vectors.dense(x), y) for x, y in labelled_blocks()], ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=2, maxBins=128, seed=1).fit(rows)

    def plain(node) -> Tree:  # noqa: ANN001
        if node.getClass().getSimpleName() == "LeafNode":
            return float(node.prediction())
        split = node.split()
        return int(split.featureIndex()), float(split.threshold()), plain(node.leftChild()), plain(node.rightChild())

    return plain(model._call_java("rootNode"))


def main_text(page: str, tree: Tree) -> str:
    blocks = blocks_of(page)
    kept = []
    for b, x in zip(blocks, features_of(blocks), strict=True):
        node = tree
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b.text)
    return "\n".join(kept)


def _extract(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", tree) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return extract


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by a line feed; empty if none), n_chars in code points.

    One pass without a shuffle over the whole html. Null html is empty, null ids and urls stay null, broken or cut
    markup is read as far as it goes, repeated rows give a row each, other columns are not read.
    """
    return pages.select("page_id", "url", "html").mapInArrow(
        _extract(trained_tree()), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint"
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
