"""Main text of web pages as the maximum-scoring subsequence of words and tags.

A page is read once as a sequence of words and tags. Words score by where they stand: inside
a page's main element, outside of it or on a page without one, and in a block that is mostly
links or not. Tags, and blocks inside elements that are named like a menu, form or advert,
score against. The weights come from how often each kind stands inside and outside the
article on labelled pages, as they are: pages that mark their article themselves (at most
``MAX_LABELLED`` of them) and a few made-up layouts. One linear scan finds the contiguous
region with the greatest sum. Blocks of the region that lie aside are left out of its text.
An element that holds most of the words around it lies nowhere aside, whatever its name.

Blocks are cut at block elements only: inline elements, whatever their names, stay in their
block, and a line break is white space. Hidden inline elements are left out. Character
references are decoded, white space becomes one space, blocks are joined by a line feed in
page order.

Null and empty pages, and pages whose best region is empty, give an empty text. Broken pages
are read as far as they go: an open comment, script or tag takes the rest. Repeated rows give
repeated results. Ties between regions go to the first. Other columns are not read.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import few_hashes, map_arrow, small_batches

MAX_LABELLED, MAX_LABELLED_CHARS = 400, 100_000
FACTORS = (1.0, 0.5, 0.25, 0.12, 0.06, 0.03)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)

# Kinds of HTML elements, and names that sites give to parts beside the article.
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "math", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr"}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "section", "table", "ul"}
MAIN = {"article", "main"}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "label", "legend", "fieldset",
              "head", "header", "datalist", "meter", "progress", "audio", "video", "canvas", "frameset"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
               "menubar", "toolbar", "status"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "advertorial", "alert", "banner", "breadcrumb",
    "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popup", "privacy",
    "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola",
    "teaser", "toc", "toolbar", "topbar", "warning", "widget"}
CONTENT_NAMES = {"article", "body", "content", "entry", "headline", "heading", "main", "post", "story", "text", "title"}


@dataclass
class Block:
    """Words between block elements, the aside elements around them and how much of them is links."""

    words: list[str]
    asides: tuple[int, ...]
    main: bool
    headline: bool  # a heading whose only aside elements are headers
    linked: bool


@dataclass
class Page:
    """tokens: (tag or "", block or -1, aside elements, in a main element) in page order."""

    tokens: list[tuple[str, int, tuple[int, ...], bool]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    in_main: list[bool] = field(default_factory=list)  # of each aside element
    has_main: bool = False

    def settle(self) -> set[int]:
        """The aside elements that count.

        One that holds over half of the page's words (or, inside the main element, of its words)
        is the page itself, whatever its name says.
        """
        held, total, main = Counter(), 0, 0
        for b in self.blocks:
            total += len(b.words)
            main += len(b.words) if b.main else 0
            held.update({a: len(b.words) for a in b.asides})
        return {a for a, inside in enumerate(self.in_main) if 2 * held[a] <= (main if inside else total)}


def _hidden(attributes: str) -> bool:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _lies_aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE_TAGS or _hidden(attributes):
        return True
    if not attributes or "=" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body"):
            for one in value.split():
                parts = {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", one)}
                if parts & ASIDE_NAMES and not parts & CONTENT_NAMES:
                    return True
                if parts & {"comment", "comments", "sidebar", "related", "advert", "advertisement", "ad", "ads"}:
                    return True
    return False


def read_page(source: str | None) -> Page:
    """The words and tags of a page, in one pass."""
    page = Page()
    stack: list[tuple[str, int, bool]] = []  # tag, number of the aside element or -1, main element
    text: list[str] = []
    hidden: list[str] = []  # open inline elements from a hidden one on
    chars, link_chars, in_link = 0, 0, False
    at, source = 0, source or ""

    def around() -> tuple[tuple[int, ...], bool]:
        return tuple(a for _, a, _ in stack if a >= 0), any(m for _, _, m in stack)

    def flush_block() -> None:
        nonlocal chars, link_chars
        words = html.unescape("".join(text)).split()
        text.clear()
        if words:
            asides, main = around()
            heading = bool(stack) and stack[-1][0] in ("h1", "h2", "h3")
            headline = heading and main and all(t == "header" for t, a, _ in stack if a >= 0)
            page.blocks.append(Block(words, asides, main, headline, 2 * link_chars >= max(1, chars)))
            page.tokens.append(("", len(page.blocks) - 1, asides, main))
        chars, link_chars = 0, 0

    def add_text(chunk: str) -> None:
        nonlocal chars, link_chars
        if not hidden:
            text.append(chunk)
            n = len(chunk.strip())
            chars += n
            link_chars += n if in_link else 0

    for m in iter(lambda: TOKEN.search(source, at), None):
        add_text(source[at:m.start()])
        at = m.end()
        opened, attributes = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        closed = (m[1] or "").lower()
        tag = opened or closed
        if not tag:
            continue
        if tag in INLINE:  # no inline element parts a block, whatever its name
            if tag == "br":
                add_text(" ")
            if tag == "a":
                in_link = bool(opened)
            if opened and tag not in VOID and (hidden or _hidden(attributes)):
                hidden.append(tag)
            elif closed and tag in hidden:
                while hidden.pop() != tag:
                    pass
            page.tokens.append((f"<{tag}>", -1, *around()))
            continue
        hidden.clear()
        flush_block()
        if opened in RAW:
            end = re.compile(rf"</\s*{re.escape(opened)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif opened:
            if stack and stack[-1][0] == "p" and opened in ENDS_PARAGRAPH or stack and stack[-1][0] == opened and opened in ("li", "dt", "dd", "tr", "td", "th", "option"):
                stack.pop()
            if opened in ("body",) and any(t == "head" for t, _, _ in stack):
                stack = [x for x in stack if x[0] != "head"]
            if opened not in VOID:
                aside, asides = _lies_aside(opened, attributes), around()
                main = opened in MAIN and not aside
                page.has_main |= main and not asides[0]
                if aside:
                    page.in_main.append(asides[1])
                stack.append((opened, len(page.in_main) - 1 if aside else -1, main))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == closed:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body", "table") and closed in ("p", "li", "b", "div"):
                    break  # a stray end tag closes nothing around it
        page.tokens.append((f"<{tag}>", -1, *around()))
    add_text(source[at:])
    flush_block()
    return page


def kinds_of(page: Page, alone: bool) -> list[tuple[str, int, int, bool]]:
    """(kind, weight of the token, block or -1, in the article) of each token.

    A block counts each of its words, one that lies aside counts once. ``alone`` leaves out
    what the main element says.
    """
    counted, out = page.settle(), []
    for tag, number, asides, main in page.tokens:
        aside = any(a in counted for a in asides)
        if tag:
            out.append((tag, 1, -1, main and not aside))
            continue
        block = page.blocks[number]
        aside &= not block.headline
        place = "alone" if alone else "in" if main else "out"
        kind = f"{'aside' if aside else 'linked' if block.linked else 'text'} {place}"
        out.append((kind, 1 if aside else len(block.words), number, main and not aside))
    return out


def fit_weights(pages: list[Page]) -> dict[str, float]:
    """Weights from how often each kind stands inside and outside of labelled articles.

    Words score log(1 + inside / outside), which is positive and near zero for what is rare in
    articles; tags and blocks that lie aside score -log(1 + outside / inside), all of them
    times the factor of ``FACTORS`` that finds the articles best where the page does not say
    where they are.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        for alone in (False, True):  # also as if the page did not say where its article is
            for kind, n, _, label in kinds_of(page, alone):
                if kind[0] != "<" or not alone:
                    (inside if label else outside)[kind] += n
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    weights = {}
    for kind in {*inside, *outside}:
        i, o = (inside[kind] + 0.5) / total_in, (outside[kind] + 0.5) / total_out
        weights[kind] = -math.log1p(o / i) if against(kind) else math.log1p(i / o)
    scaled = [{k: w * factor if against(k) else w for k, w in weights.items()} for factor in FACTORS]
    marked = [kinds_of(page, True) for page in pages if page.has_main]
    return max(scaled, key=lambda w: (found_share(marked, w), -scaled.index(w)))


def against(kind: str) -> bool:
    return kind[0] == "<" or kind.startswith("aside")


def found_share(pages: list[list[tuple[str, int, int, bool]]], weights: dict[str, float]) -> float:
    """Mean agreement (intersection over union, in words) of the regions with the articles."""
    shares = []
    for tokens in pages:
        start, end = best_region([weights[kind] * n for kind, n, _, _ in tokens])
        both = union = 0
        for k, (kind, n, _, label) in enumerate(tokens):
            if not against(kind):
                both += n if label and start <= k < end else 0
                union += n if label or start <= k < end else 0
        shares.append(both / union if union else 1.0)
    return round(sum(shares) / max(1, len(shares)), 6)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum, in one scan."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def scored_tokens(page: Page, weights: dict[str, float]) -> list[tuple[float, int]]:
    """(score, block to be shown or -1) of each token; kinds that were never seen count as equally often in both places."""
    unseen = lambda kind: -math.log(2) * FACTORS[2] if against(kind) else math.log(2)
    return [(weights.get(kind, unseen(kind)) * n, -1 if kind.startswith("aside") else number)
            for kind, n, number, _ in kinds_of(page, not page.has_main)]


def main_text(source: str | None, weights: dict[str, float]) -> str:
    page = read_page(source)
    tokens = scored_tokens(page, weights)
    start, end = best_region([s for s, _ in tokens])
    return "\n".join(" ".join(page.blocks[b].words) for _, b in tokens[start:end] if b >= 0)


def layouts() -> list[str]:
    """A few made-up pages of known layout, so that common parts have weights in any corpus."""
    body = "".join(f"<p>{'word ' * n}</p>" for n in (40, 25, 60))
    inner = ("<h2>part two</h2><p>as <a href='/z'>they</a> say <b>word</b> for <i>word</i></p>"
             "<ul><li>first point</li><li>second point of it</li><li>third</li></ul>"
             "<table><tr><td>one</td><td>two</td></tr></table><blockquote>said it</blockquote>")
    aside = ("<header><a href='/'>site</a></header><nav><ul>" + "<li><a href='/x'>one</a></li>" * 6 + "</ul></nav>"
             "<div class='cookie-notice'>we use cookies <button>ok</button></div>")
    plain = "<div>" + "<a href='/x'>some</a> " * 5 + "</div><div><ul>" + "<li><a href='/x'>more of that</a></li>" * 6 + "</ul></div>"
    after = ("<aside class='sidebar'><h3>more</h3><ul>" + "<li><a href='/y'>two three</a></li>" * 5 + "</ul></aside>"
             "<form><label>mail</label><input></form><section class='comments'><p>nice words here</p></section>"
             "<footer>all rights</footer>")
    return [f"<html><body>{before}<{tag}><h1>a title</h1>{body}<div class='ad'>buy now</div>{middle}{body}</{tag}>{end}</body></html>"
            for tag in ("article", "main") for before, end in ((aside, after), (plain, plain)) for middle in ("", inner)]


def train(pages: DataFrame, html_column: str = "html", id_column: str = "page_id", limit: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from pages that mark their article, at most ``limit`` of bounded length, and the layouts."""
    source = F.col(html_column).cast("string")
    marked = pages.filter(source.rlike("(?i)<(article|main)[ >]") & (F.length(source) <= MAX_LABELLED_CHARS))
    few = F.broadcast(few_hashes(marked, id_column, limit))  # ``limit`` rows at most
    some = (marked.select(F.xxhash64(id_column).alias("h"), source.alias("s")).join(few, "h")
            .groupBy("h").agg(F.min("s").alias("s")).orderBy("h").collect())
    return fit_weights([read_page(s) for s in [*layouts(), *(r.s for r in some)]])


def _text_batches(batches, weights):
    for batch in small_batches(batches, 200):
        texts = [main_text(s, weights) for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, weights: dict[str, float], id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """page_id, url and text for every page."""
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        F.col(html_column).cast("string").alias("html"))
    return map_arrow(rows, functools.partial(_text_batches, weights=weights), "page_id bigint, url string, text string")
