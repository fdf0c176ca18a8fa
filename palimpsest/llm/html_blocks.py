"""Main text of web pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat blocks of text.  Each block has a
word count and a link density, those of its neighbours, and a few facts about
where it stands: tags that set parts aside, and how much the names of the elements
around it, up to the article, speak of such parts.  A decision tree, grown in numpy on
the small labelled table that ``examples.py`` writes out, weighs all of this and says
which blocks are the article; no tag and no word decides alone.

Pages never meet: there is no shuffle.  Null and empty pages have an empty text;
broken markup ends blocks where its tags are; a tag that is never closed reaches
to the end of the element around it, an unclosed quote to the next space or tag end.
A page is read once, in time linear in its length.  Texts are taken whole at any
length; repeated pages repeat; other columns are ignored; no pages give no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.frames import arrow_map

#: Elements whose text is never shown as part of a page.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
#: Elements inside a line of text; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that can't hold anything.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold parts of a page that aren't its article.
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTED = frozenset("li dt dd td th".split())
#: Elements that end an open one of their kind, or an open paragraph.
ENDS_ITS_KIND = frozenset("p li dt dd tr td th option".split()) | HEADING
#: Names (of class, id or role) of such parts, as whole words between separators.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar side rail aside widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus discussion reply replies respond related recommended "
    "recommendations more popular trending pager pagination tags toc copyright legal disclaimer search form skip".split()
)
#: A quote opens a value only after an equals sign; a value whose quote never closes ends where a bare one would.
_ATTRIBUTE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>]*)"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{_ATTRIBUTE})*)(?:>|\Z)", re.S)
_PAIR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "density_around", "set_aside", "name_share", "in_article", "page_has_article", "heading", "listed", "ends_sentence")


@dataclass
class Block:
    text: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    set_aside: bool = False
    name_share: float = 0.0
    in_article: bool = False
    heading: bool = False
    listed: bool = False


def name_share(attributes: str) -> float:
    """How much the names of an element speak of a part that isn't the article: 1 for hidden ones.

    A class, id or role of several words counts by the share of its words that are in ``NAMES``.
    """
    most = 0.0
    for m in _PAIR.finditer(attributes):
        key, said = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and said.strip().lower() == "true") or (key == "style" and _HIDDEN.search(said)):
            return 1.0
        if key in ("class", "id", "role"):
            for name in said.split():
                parts = _PARTS.findall(_CAMEL.sub(" ", name).lower())
                if parts:
                    most = max(most, sum(p in NAMES for p in parts) / len(parts))
    return most


@dataclass
class Open:
    """An element that is open, with what holds inside it."""

    name: str = ""
    set_aside: bool = False
    name_share: float = 0.0
    in_article: bool = False

    def inside(self, name: str, attributes: str) -> Open:
        """An element in this one.  An article takes no names from around it, and of its own only a whole one."""
        opens, share = name in ("article", "main"), name_share(attributes)
        if opens or name in ("html", "body"):
            share = max(float(share == 1) * (name != "body"), self.name_share if self.in_article else 0.0)
        else:
            share = max(share, self.name_share)
        return Open(name, self.set_aside or (name in ASIDE and not (name == "header" and self.in_article)), share, self.in_article or opens)


def _end_of(page: str, name: str, at: int, known: dict[str, list[tuple[int, int]]]) -> int | None:
    """Where the next end tag of that name ends; all of a name are looked for once."""
    if name not in known:
        known[name] = [(m.start(), m.end()) for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", page, re.I)]
    ends = known[name]
    i = bisect_left(ends, (at, 0))
    return ends[i][1] if i < len(ends) else None


def blocks_of(page: str) -> tuple[list[tuple[str, Block]], bool]:
    """(text, block) of each block with any text, and whether the page marks an article."""
    out: list[tuple[str, Block]] = []
    stack = [Open()]
    now = Block()
    linked = article = False
    ends: dict[str, list[tuple[int, int]]] = {}
    at, n = 0, len(page)

    def end_block() -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.text)).split())
        if text:
            out.append((text, now))
        top, near = stack[-1], {x.name for x in stack[-3:]}
        now = Block(set_aside=top.set_aside, name_share=top.name_share, in_article=top.in_article, heading=not near.isdisjoint(HEADING), listed=not near.isdisjoint(LISTED))

    def say(text: str) -> None:
        if text:
            now.text.append(text)
            if linked:
                now.linked.append(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] or ""
        bare = attributes.rstrip().endswith("/") and not attributes.rstrip().endswith("=/")
        if name in SILENT and not closing:
            if not bare or name in ("script", "style"):
                end = _end_of(page, name, at, ends)
                if name == "head" and end is None:
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    end = body.start() if body else None
                at = end if end is not None else (n if name in ("script", "style") else at)
            if name not in ("button", "select", "textarea"):
                end_block()
            continue
        if name == "a":
            linked = not closing
            continue
        if name == "br":
            say(" ")
            continue
        if name in INLINE:
            continue
        if closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k:
                del stack[k:]
                linked = False
        elif name not in VOID and not bare:
            if name in ENDS_ITS_KIND and stack[-1].name in (name, "p"):
                stack.pop()
            stack.append(stack[-1].inside(name, attributes))
            article |= stack[-1].in_article and stack[-1].name_share < 1
        end_block()
    end_block()
    return out, article


def features(blocks: list[tuple[str, Block]], article: bool) -> np.ndarray:
    words = np.array([len(t.split()) for t, _ in blocks], float)
    links = np.array([len(html.unescape("".join(b.linked)).split()) for _, b in blocks], float)
    density = np.minimum(1.0, links / np.maximum(words, 1))

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([np.zeros(min(by, len(x))), x[:-by]]) if by > 0 else np.concatenate([x[-by:], np.zeros(min(-by, len(x)))])

    around = [sum(shifted(x, k) if k else x for k in (-2, -1, 0, 1, 2)) for x in (words * density, words)]
    facts = np.array([[b.set_aside, b.name_share, b.in_article, article, b.heading, b.listed, t.rstrip("\"'”’»)").endswith((".", "!", "?", "…", ":"))] for t, b in blocks], float)
    return np.column_stack([words, density, shifted(words, 1), shifted(density, 1), shifted(words, -1), shifted(density, -1), around[0] / np.maximum(around[1], 1), facts])


@dataclass
class Tree:
    """A decision tree as arrays; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            at = np.where(x[np.arange(len(x)), self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.label[at]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> Tree:
    """A tree by Gini impurity, with ``least`` rows in a leaf; of equal splits the first feature and the lowest threshold win."""
    nodes: list[list[float]] = []

    def impurity(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = k / np.maximum(n, 1)
        return n * 2 * p * (1 - p)

    def node(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, float(y[rows].mean() >= 0.5)])
        if level < depth and 0 < y[rows].sum() < len(rows):
            best = None
            whole = impurity(np.array([y[rows].sum()]), np.array([len(rows)]))[0]
            for j in range(x.shape[1]):
                order = np.argsort(x[rows, j], kind="stable")
                v, k = x[rows, j][order], np.cumsum(y[rows][order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
                if len(cut):
                    left = cut + 1
                    cost = impurity(k[cut], left) + impurity(k[-1] - k[cut], len(rows) - left)
                    i = int(np.argmin(cost))
                    if whole - cost[i] > 1e-9 and (best is None or cost[i] < best[0] - 1e-9):
                        best = (cost[i], j, (v[cut[i]] + v[cut[i] + 1]) / 2)
            if best:
                side = x[rows, best[1]] <= best[2]
                left, right = node(rows[side], level + 1), node(rows[~side], level + 1)
                nodes[at] = [best[1], best[2], left, right, nodes[at][4]]
        return at

    node(np.arange(len(y)), 0)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4] > 0, depth)


def trained() -> Tree:
    """The tree of the labelled table."""
    from palimpsest.llm.examples import labelled_pages

    xs, ys = [], []
    for page in labelled_pages():
        blocks, article = blocks_of(page)
        labels = [t[0] for t, _ in blocks]
        if set(labels) - {"+", "-"}:
            raise ValueError("each block of an example starts with its label")
        bare = [(t[1:].strip(), b) for t, b in blocks]
        xs.append(features(bare, article))
        ys.append(np.array([c == "+" for c in labels], float))
    return grow(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str | None, tree: Tree) -> str:
    if not page:
        return ""
    blocks, article = blocks_of(page)
    if not blocks:
        return ""
    keep = tree.predict(features(blocks, article))
    return "\n\n".join(t for (t, _), k in zip(blocks, keep, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tree = trained()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [main_text(p.as_py(), tree) for p in batch.column("html")]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": np.array([len(t) for t in texts], np.int64)}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, run, "page_id long, url string, text string, n_chars long")
