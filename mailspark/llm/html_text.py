"""Main text of web pages by a site style tree.

The element trees of all pages of a host are merged: elements with the same path of
tags and classes, and the same mark, are one node. A node has the presentations
(sequences of child elements) and contents it shows over the pages of its host, and how
varied they are (Yi, Liu and Li, 2003) is its evidence: the entropy of the presentations,
scaled to 0..1, or one minus the mean relative entropy of its contents, whichever is
larger. A node seen n times has ``(n * evidence + STRENGTH) / (n + STRENGTH)`` of it, so
one that was seen a few times counts as varied, without a step at any number of pages.
A branch whose importance is below ``THRESHOLD`` is removed from each page.

Entropies cannot tell articles from menus, footers and adverts with other words on every
page. The marks HTML has for these are priors: a mark gives the band in which the
evidence places the importance of a node (``BANDS``). Named as something else than the
article (tag, role, class words), or outside of a page's article or main element: a low
band. Elements of the article without a class or id, which have no style to merge by: the
upper half. All others, among them classed parts of an article: the whole range.

Cases: a null page and a page without text give an empty text. A null or broken url
counts as its own host, the empty one. Unclosed elements end where HTML ends them,
at the latest with the page; nesting is followed however deep. Text of an inline element
that is named as noise is not read. Equal rows of pages give equal rows. Very long pages
are read one at a time; nothing is cut. Other columns of ``pages`` are not looked at,
whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.llm.common import fits_broadcast
from mailspark.session import stored

THRESHOLD = 0.2
# How many sightings of a varied node a node starts with.
STRENGTH = 2.5
# By mark: named as noise or outside the article; nothing known; plain part of an article.
NOISE, OPEN, PLAIN = 0, 1, 2
BANDS = {NOISE: (0.0, 0.15), OPEN: (0.0, 1.0), PLAIN: (0.5, 1.0)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|title|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+(?=>)|[^<>]*)>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

# Fixed values of HTML: elements without content, text elements inside a block, and
# elements that a following sibling ends.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark meter q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
_ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
        "main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
    "head": frozenset(["body"]),
}
_SCOPE = frozenset("article aside body div footer form header li main nav ol section table td th ul".split())
_PLAIN = frozenset(
    "div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr td th caption figure figcaption "
    "address hr center".split()) | _INLINE
_MAIN = frozenset(["article", "main"])

# Elements, roles and class words that name what is not the article.
_NOISE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox banner banners sponsor sponsored promo promos "
    "promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager toc masthead "
    "topbar footer foot sidebar sidebars aside comment comments commentlist disqus reply replies cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription signup login social share sharing sharebar skiplink".split())
# Words that can also name a part of an article, and count outside of it only.
_OUTER_WORDS = frozenset(
    "header rail widget widgets related recommended recommendations respond notification alert popup modal overlay follow form "
    "search searchbox copyright legal disclaimer skip hidden".split())
_NOT_MAIN = frozenset("ad advert comment comments promo related reply replies sponsored teaser".split())


class _Node:
    """An open or closed element. ``at`` is its number in the page, or its block's."""

    __slots__ = ("tag", "key", "noise", "main", "styled", "holds_main", "at", "children", "content")

    def __init__(self, tag: str, key: int, noise: bool, main: bool, styled: bool, at: int):
        self.tag, self.key, self.noise, self.main, self.styled, self.at = tag, key, noise, main, styled, at
        self.holds_main, self.children, self.content = False, [], 0

    def mark(self, has_main: bool) -> int:
        if self.noise or (has_main and not self.main and not self.holds_main):
            return NOISE
        return PLAIN if self.main and not self.styled else OPEN


def _label(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """What identifies a style, and whether it is marked as not the article.

    ``inside`` the article, fewer words are such marks.
    """
    noise = tag in _NOISE_TAGS
    name = tag
    if attributes and not attributes.isspace():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id") and value:
                words = re.findall(r"[a-z]+", value)
                if tag in _MAIN:
                    noise = noise or any(w in _NOT_MAIN for w in words)
                elif tag not in ("body", "html"):
                    noise = noise or any(w in _NOISE_WORDS or (w in _OUTER_WORDS and not inside) for w in words)
                # Long numbers are of one page, not of a style.
                style = "-".join(re.sub(r"\d{3,}", "", value).split())
                name += f".{style}" if key == "class" else f"#{style}"
            elif key == "role":
                noise = noise or value in _NOISE_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                noise = True
    return name, noise


def read_page(page: str) -> tuple[list[str], list[list[int]], list[tuple[int, int, int, int]], int]:
    """Blocks of a page, the nodes each is in, the nodes, and a hash of the article.

    A node is a block element: a hash of its path and mark, its mark, a hash of the
    sequence of its child elements, and one of its text. Text beside the article, in an
    element that holds it, is a node of its own, as is text that is in no element. The
    hash of the article is that of all text that no mark names as noise.
    """
    root = _Node("", 0, False, False, False, 0)
    stack, nodes = [root], [root]
    blocks: list[tuple[str, list[_Node]]] = []
    pending: list[str] = []
    # The open elements where the pending text began.
    where: list[list[_Node]] = [stack]
    has_main = False

    def flush():
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                # Inline elements stand for the block they are in.
                blocks.append((text, [nodes[at] for at in dict.fromkeys(n.at for n in where[0])]))

    def text(piece: str):
        if stack[-1].tag in _INLINE and stack[-1].noise and not nodes[stack[-1].at].noise:
            return
        if not pending:
            if piece.isspace():
                return
            where[0] = list(stack)
        pending.append(piece)

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            text(page[at:token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if token[2]:
            if tag not in _INLINE:
                flush()
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag in _INLINE and stack[depth].tag not in _INLINE:
                    break
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br" and pending:
            pending.append(" ")
        # What this element ends: open inline elements do not outlive their block.
        for depth in range(len(stack) - 1, 0, -1):
            ended = _ENDED_BY.get(stack[depth].tag)
            if ended and tag in ended:
                del stack[depth:]
                break
            if stack[depth].tag in _SCOPE:
                break
        parent = stack[-1]
        name, noise = _label(tag, token[4], parent.main)
        parent.children.append(name)
        if tag in _VOID:
            continue
        # A header of a section inside the article is a heading; elsewhere it is the site's.
        noise = parent.noise or noise or (tag == "header" and not parent.main)
        main = parent.main or (tag in _MAIN and not noise)
        if main and not parent.main:
            has_main = True
            for above in stack:
                above.holds_main = True
        inline = tag in _INLINE
        styled = name != tag or tag not in _PLAIN
        node = _Node(
            tag, parent.key if inline else _hash(name, parent.key), noise, main, styled and tag not in _MAIN,
            parent.at if inline else len(nodes))
        if not inline:
            nodes.append(node)
        stack.append(node)
    if at < len(page):
        text(page[at:])
    flush()

    article = 0
    for piece, inside in blocks:
        inner = inside[-1]
        if inner.holds_main or inner is root or inner.tag in ("html", "body"):
            loose = _Node("", _hash("#text", inner.key), inner.noise, inner.main, True, len(nodes))
            nodes.append(loose)
            inside.append(loose)
        digest = _hash(piece)
        for node in inside:
            node.content = _hash(str(digest), node.content)
        if inside[-1].mark(has_main) != NOISE:
            article = _hash(str(digest), article)
    found = []
    for node in nodes:
        mark = node.mark(has_main)
        found.append((_signed(_hash(str(mark), node.key)), mark, _signed(_hash("|".join(node.children))), _signed(node.content)))
    return [b[0] for b in blocks], [[n.at for n in b[1]] for b in blocks], found, _signed(article)


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _signed(value: int) -> int:
    return value - (1 << 63)


def _read(pages: DataFrame) -> DataFrame:
    """Pages with their blocks and nodes."""
    node = pa.struct([("key", pa.int64()), ("mark", pa.int8()), ("shape", pa.int64()), ("content", pa.int64())])
    names = [field.name for field in node]
    types = {"page_id": pa.int64(), "url": pa.string(), "host": pa.string(), "blocks": pa.list_(pa.string()),
             "inside": pa.list_(pa.list_(pa.int32())), "nodes": pa.list_(node), "article": pa.int64()}

    def run(batches):
        for batch in batches:
            # A part at a time: pages can be long.
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                read = [read_page(page or "") for page in part.column(3).to_pylist()]
                columns = [part.column(0), part.column(1), part.column(2),
                           pa.array([r[0] for r in read], types["blocks"]), pa.array([r[1] for r in read], types["inside"]),
                           pa.array([[dict(zip(names, n)) for n in r[2]] for r in read], types["nodes"]),
                           pa.array([r[3] for r in read], types["article"])]
                yield pa.RecordBatch.from_arrays(columns, list(types))

    schema = ("page_id bigint, url string, host string, blocks array<string>, inside array<array<int>>, "
              "nodes array<struct<key: bigint, mark: tinyint, shape: bigint, content: bigint>>, article bigint")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string")).mapInArrow(run, schema)


def style_tree(read: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """``host, key, seen, evidence, importance`` of every node of the merged trees.

    Occurrences are counted per value before they meet per node, so a node with any
    number of pages costs one row per different value.
    """
    # Pages of a host with the same article count once: copies are no template. Which of
    # the copies stands for it is settled by their nodes.
    once = read.groupBy("host", "article").agg(F.min_by("nodes", F.xxhash64("nodes")).alias("nodes"))
    nodes = once.select("host", F.inline("nodes"))
    totals = nodes.groupBy("host", "key", "mark").agg(F.count("*").alias("seen"))

    def entropies(value: str):
        counts = nodes.groupBy("host", "key", value).agg(F.count("*").alias("c"))
        # Sums from which both entropies follow once the total is known.
        return counts.groupBy("host", "key").agg(
            F.count("*").alias(f"{value}_kinds"), F.sum(F.col("c") * F.log("c")).alias(f"{value}_clogc"),
            F.sum(F.log("c")).alias(f"{value}_logc"))

    joined = totals.join(entropies("shape"), ["host", "key"]).join(entropies("content"), ["host", "key"])
    m = F.log("seen")
    # Entropy of the presentations over the choice of them, scaled by its maximum.
    shape = F.when(F.col("seen") > 1, (m - F.col("shape_clogc") / F.col("seen")) / m).otherwise(1.0)
    # One minus the mean over contents of log(sightings of it) / log(sightings).
    content = F.when(F.col("seen") > 1, 1 - F.col("content_logc") / F.col("content_kinds") / m).otherwise(1.0)
    joined = joined.select("host", "key", "mark", "seen", F.greatest(shape, content).alias("evidence"))
    sure = (F.col("seen") * F.col("evidence") + strength) / (F.col("seen") + strength)
    bands = [F.lit(low) + (high - low) * sure for low, high in (BANDS[mark] for mark in sorted(BANDS))]
    return joined.select("host", "key", "seen", "evidence", F.get(F.array(*bands), F.col("mark").cast("int")).alias("importance"))


def main_text(pages: DataFrame, threshold: float = THRESHOLD, strength: float = STRENGTH) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    keys = F.array_sort(F.array_distinct(F.col("nodes.key")))
    read = stored(_read(pages).withColumn("layout", F.xxhash64(keys)), "pages")
    poor = style_tree(read, strength).where(F.col("importance") < threshold).select("host", "key")
    # Pages of a host with the same nodes lose the same ones, so the lists are per layout
    # and no longer than a page.
    layouts = read.groupBy("host", "layout").agg(F.min(keys).alias("keys"))
    lost = stored(layouts.select("host", "layout", F.explode("keys").alias("key")).join(poor, ["host", "key"]), "template")
    small = fits_broadcast(lost, 100_000)
    lost = lost.groupBy("host", "layout").agg(F.array_sort(F.collect_list("key")).alias("poor"))
    if small:
        lost = F.broadcast(lost)
    joined = read.join(lost, ["host", "layout"], "left")
    places = F.sequence(F.lit(0), F.size("nodes") - 1)
    removed = F.filter(places, lambda n: F.array_contains(F.col("poor"), F.get(F.col("nodes"), n)["key"]))
    removed = F.when(F.col("poor").isNull(), F.array().cast("array<int>")).otherwise(removed)
    joined = joined.select("page_id", "url", "blocks", "inside", removed.alias("removed"))
    pairs = F.filter(F.arrays_zip("blocks", "inside"), lambda b: ~F.arrays_overlap(b["inside"], F.col("removed")))
    kept = F.when(F.size("removed") == 0, F.col("blocks")).otherwise(F.transform(pairs, lambda b: b["blocks"]))
    text = F.array_join(kept, "\n")
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))
