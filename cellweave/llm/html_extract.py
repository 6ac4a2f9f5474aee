"""Main text of web pages by tag-path ratios.

A page is read once into its blocks of text, each with its root-to-leaf path of block-level tags. For every path the text
length, the number of text nodes, and the punctuation are added up; the fused score of a path is its mean text length times its
punctuation ratio, smoothed over the neighbouring blocks of the same part of the page so that short headings inside an article are
lifted by the paragraphs around them, times the share of its text outside links. Parts are the children of the body. Blocks above a threshold relative to the page are
content. What a path says by itself (navigation, header, footer, sidebar, form, script, an ``ad``- or ``comment``-like class)
excludes it. An article element is a feature of the score: on a page that has one, blocks outside of all articles weigh less.

Pages are independent rows, so there is no shuffle, and a partition is worked through batch by batch. Paths are numbers that are
made from the number of the parent, so a page of very many unclosed tags takes time in proportion to its length.

Defined results: a null html, or one without content, gives the empty text; character references are decoded; unclosed and
wrongly nested tags are closed as browsers do for paragraphs and list items; text cut off inside a tag is dropped with the tag;
repeated rows are extracted alike; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Opening one of these closes an open paragraph.
BREAKS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
BOUNDARY = {"article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "ol", "section", "table", "td", "th", "ul"}
EXCLUDED = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "object"} | RAW
NOISE = re.compile(r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|breadcrumbs?|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|comments?|disqus|replies|footer|header|masthead|widget|pagination|login|signup|toc)(?:$|[\s_-])")
#: What excludes an article element, whose other class names say nothing.
COMMENT = re.compile(r"(?i)(?:^|\s)(?:comments?|reply|replies)(?:$|\s)")
#: Weight of a block outside of all articles of a page.
OUTSIDE = 0.05
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")
SPACES = re.compile(r"\s+")


@dataclass
class Block:
    path: int
    part: int
    article: int
    excluded: bool
    linked: int = 0
    chars: list[str] = field(default_factory=list)
    text: str = ""


@dataclass(frozen=True, slots=True)
class Open:
    """An open element, with what its place in the page says. depth: of block elements below the body."""

    tag: str
    excluded: bool = False
    article: int = 0
    path: int = 0
    link: bool = False
    part: int = 0
    depth: int = 0


PAGE = Open("")


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with white space collapsed; empty ones are left out."""
    stack: list[Open] = []
    count: Counter[str] = Counter()  # open elements by tag
    paths: dict[tuple[int, str], int] = {}
    out: list[Block] = []
    now: Block | None = None
    at = articles = parts = 0
    low = None

    def text(s: str) -> None:
        nonlocal now
        if not s:
            return
        top = stack[-1] if stack else PAGE
        if now is not None and now.excluded != top.excluded:
            now = None
        if now is None:
            if not s.strip():
                return
            now = Block(top.path, top.part if top.depth > 1 else 0, top.article, top.excluded)
            out.append(now)
        s = entities.unescape(s) if "&" in s else s
        if top.link:
            now.linked += len(s)
        now.chars.append(s)

    def close(tag: str) -> None:
        nonlocal now
        if not count[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag == tag:
                if any(x.tag not in INLINE for x in stack[k:]):
                    now = None
                count.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if tag in INLINE and stack[k].tag not in INLINE or tag not in BOUNDARY and stack[k].tag in BOUNDARY:
                return

    def push(tag: str, excluded: bool, article: int) -> None:
        nonlocal parts
        top = stack[-1] if stack else PAGE
        path, part, depth = top.path, top.part, top.depth
        if tag not in INLINE:
            path = paths.setdefault((path, tag), len(paths) + 1)
            if tag not in ("html", "body"):
                depth += 1
                if depth == 1:
                    parts += 1
                    part = parts
        stack.append(Open(tag, excluded, article, path, top.link or tag == "a", part, depth))
        count[tag] += 1

    while (m := TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            close(tag)
            continue
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            if end < 0:
                at = len(page) if tag in ("script", "style") else at
                continue
            at = page.find(">", end) + 1 or len(page)
            continue
        if tag == "br":
            if now is not None:
                now.chars.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                now = None
            continue
        if tag in BREAKS_P:
            close("p")
        for other in CLOSES.get(tag, ()):
            close(other)
        if tag not in INLINE:
            now = None
        top = stack[-1] if stack else PAGE
        excluded, article = top.excluded, top.article
        if tag == "article" and not article:
            articles += 1
            article = articles
        attributes = m[3]
        if not excluded:
            excluded = tag in EXCLUDED and not (tag == "header" and article) or bool(attributes) and (bool(HIDDEN.search(attributes)) or any(NOISE.search(a or b or c) for a, b, c in ATTRIBUTE.findall(attributes)) and tag not in ("html", "body", "article", "main"))
            excluded = excluded or tag == "article" and any(COMMENT.search(a or b or c) for a, b, c in ATTRIBUTE.findall(attributes))
        if not attributes.rstrip().endswith("/") or tag in BOUNDARY:
            push(tag, excluded, article)
    text(page[at:])
    for b in out:
        b.text = SPACES.sub(" ", "".join(b.chars)).strip()
    return [b for b in out if b.text]


def path_scores(blocks: list[Block], smooth: int = 1) -> list[float]:
    """The smoothed, fused score of each block's path."""
    any_article = any(b.article for b in blocks)
    length, marks, links, nodes = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        length[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        links[b.path] += min(b.linked, len(b.text))
        nodes[b.path] += 1
    own = [1 - links[b.path] / length[b.path] for b in blocks]
    fused = [length[b.path] / nodes[b.path] * (1 + marks[b.path]) / nodes[b.path] ** 0.5 * o for b, o in zip(blocks, own, strict=True)]
    weight = [1.0 if b.article or not any_article else OUTSIDE for b in blocks]
    out = []
    for i, (b, o, w) in enumerate(zip(blocks, own, weight, strict=True)):
        near = [fused[j] for j in range(max(0, i - smooth), min(len(blocks), i + smooth + 1)) if blocks[j].part == b.part]
        out.append(w * o * sum(near) / len(near))  # links are not smoothed: a row of them beside paragraphs is no heading
    return out


def main_text(page: str | None, threshold: float = 0.1, bare: float = 0.25) -> str:
    """The content blocks of a page, one a line; threshold: least score of a block as a part of the page's mean score; bare: the same
    for pages without article elements, where less tells a notice from a short paragraph."""
    if not page:
        return ""
    blocks = [b for b in blocks_of(page) if not b.excluded]
    if not blocks:
        return ""
    scores = path_scores(blocks)
    least = (threshold if any(b.article for b in blocks) else bare) * sum(scores) / len(scores)
    return "\n".join(b.text for b, s in zip(blocks, scores, strict=True) if s >= least)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.1, bare: float = 0.25) -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), threshold, bare) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(work, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint")
