"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: an element is the path of block elements to it, with their
classes. A node's importance joins how varied the presentation below it is (the entropy of the orders of
its children over the pages) and how particular its content is (one less the entropy of each of its text
blocks over the pages, so a block that all pages share counts nothing). Branches of low importance are
removed from each page. What a tag or class says is known beforehand: menus, headers, footers, sidebars,
notices, adverts, forms, scripts and reader comments have no importance, and an article or main element
is never noise, so pages of hosts with too few pages to compare are cleaned as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chartloom.llm.common import stored, text_of

#: Least importance of a branch that stays, and distinct pages that a host needs for the comparison.
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 4
GAMMA = 0.9
#: Low branches (16 bytes each) that may travel to all tasks; more of them are joined by host.
MOST_BROADCAST = 1_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)|\Z", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template")}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address hgroup details summary fieldset center header footer nav aside form "
    "menu dialog head".split()
)
CLOSES_P = BLOCKS - {"html", "body", "head"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FURNITURE_TAGS = set("nav footer aside form head menu dialog button select option svg canvas iframe object video audio".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar widget nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices gdpr popup modal newsletter "
    "subscribe share sharing social related recommended comment comments disqus respond replies complementary contentinfo search".split()
)
#: Words of a furniture's name that say only how it holds its content; in an article every other word speaks for it.
HOLDER_WORDS = set(
    "area bar block body box btn button buttons container content form group heading inner item items label link links list "
    "outer panel placeholder post posts row section slot stories story strip thread title unit wrap wrapper zone".split()
)
MAIN = {"article", "main"}
WORD = re.compile(r"[a-z]+")


def _names(attributes: str, main: bool) -> tuple[str, bool]:
    """The classes, and whether a class, id or role names furniture: by any word of it, inside an article or main
    element only by a name that says nothing else (``share-buttons``, but not ``share-price``)."""
    found = [(k.lower(), v.strip("\"'").lower()) for k, v in NAMES.findall(attributes)] if attributes else []
    classes = " ".join(v for k, v in found if k == "class").split()
    names = [set(WORD.findall(name)) for _, v in found for name in v.split()]
    known = any(words & FURNITURE_WORDS and (not main or words <= FURNITURE_WORDS | HOLDER_WORDS) for words in names)
    return "".join(f".{c}" for c in sorted(classes)), known


class _Node:
    __slots__ = ("tag", "path", "noise", "main", "children")

    def __init__(self, tag, path, noise, main):
        self.tag, self.path, self.noise, self.main, self.children = tag, path, noise, main, []


def read_page(html: str):
    """Blocks of the page in order as (path, in an article or main element, text), without those of known
    furniture, and the children of each path's elements."""
    root = _Node("", "", False, False)
    stack, blocks, nodes, words = [root], [], [root], []
    skipped = 0  # depth of inline furniture such as buttons

    def close_block():
        if words:
            text = " ".join(unescape("".join(words)).split())
            words.clear()
            top = stack[-1]
            if text and not top.noise:
                blocks.append((top.path, top.main, text))

    at, end = 0, len(html)
    while at < end:
        match = TOKEN.search(html, at)
        if match is None:
            if not skipped:
                words.append(html[at:])
            break
        if match.start() > at and not skipped:
            words.append(html[at : match.start()])
        at = match.end()
        closing, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if not closing and tag in RAW:
            at = RAW[tag].search(html, at).end()
            if tag == "textarea":
                words.append(" ")
            continue
        if tag in BLOCKS:
            close_block()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                continue
            if tag in CLOSES_P and stack[-1].tag == "p":
                stack.pop()
            if tag in SAME_CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SAME_CLOSES[tag]:
                        del stack[i:]
                        break
                    if stack[i].tag in ("ul", "ol", "dl", "table"):
                        break
            parent = stack[-1]
            main = parent.main or tag in MAIN
            classes, named = _names(attributes, main)
            noise = parent.noise or tag in FURNITURE_TAGS or named or (tag == "header" and not main)
            if tag in ("html", "body", "article", "main"):  # classes of the whole page say nothing about it
                noise = parent.noise
            node = _Node(tag, f"{parent.path}/{tag}{classes}", noise, main)
            parent.children.append(tag + classes)
            stack.append(node)
            nodes.append(node)
        elif tag in FURNITURE_TAGS:
            skipped = max(0, skipped + (-1 if closing else 1)) if tag not in VOID else skipped
        elif tag == "br" or tag == "hr":
            words.append(" ")
    close_block()
    return blocks, nodes


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def host(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``site, page, items``: of each page of a host the hash of its blocks, and its nodes with their text
    blocks (kind 0) and orders of children (1). Pages without a host are not compared."""
    for batch in batches:
        rows: dict[tuple[int, int], bytes] = {}
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            if not (name := host(url)):
                continue
            blocks, nodes = read_page(html)
            texts = [(_hash(path), 0, _hash(text)) for path, _, text in blocks]
            key = _hash(name), _hash(repr(texts))
            if key not in rows:
                orders = {(_hash(n.path), 1, _hash(" ".join(n.children))) for n in nodes if n.path and not n.noise}
                rows[key] = np.array([*set(texts), *orders], np.int64).tobytes()
        if rows:
            columns = [pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int64()), pa.array(list(rows.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["site", "page", "items"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of distinct pages by host, node and either text block (kind 0) or order of children (1); each
    host's pages are kind 2."""
    for batch in batches:
        counts: Counter = Counter()
        for site, raw in zip(batch.column("site").to_pylist(), batch.column("items").to_pylist()):
            counts[site, 0, 2, 0] += 1
            counts.update((site, *item) for item in np.frombuffer(raw, np.int64).reshape(-1, 3).tolist())
        if counts:
            columns = np.array([(*key, n) for key, n in counts.items()], np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["site", "node", "kind", "item", "n"])


def style_tree(pages: DataFrame) -> DataFrame:
    """``site, node, importance`` of every node of the merged pages (``url, html``), as 64-bit hashes.
    Pages of the same blocks count once, so that copies of a page are not taken for template."""
    distinct = pages.mapInArrow(_items, "site long, page long, items binary").dropDuplicates(["site", "page"])
    counted = distinct.mapInArrow(_merge, "site long, node long, kind long, item long, n long")
    counted = stored(counted.groupBy("site", "node", "kind", "item").agg(F.sum("n").alias("n")), "style-tree")
    n_pages = counted.where("kind = 2").select("site", F.col("n").alias("pages"))
    parts = counted.where("kind < 2").join(n_pages, "site").where(F.col("pages") >= LEAST_PAGES)
    apart = F.log(F.col("n")) / F.log(F.col("pages"))  # entropy of an item that is once on each of n pages
    nodes = parts.groupBy("site", "node").agg(
        (F.sum(F.when(F.col("kind") == 0, F.col("n") * (1 - apart))) / F.sum(F.when(F.col("kind") == 0, F.col("n")))).alias("content"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("total"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log(F.col("n")))).alias("spread"),
        F.sum(F.when(F.col("kind") == 1, 1)).alias("orders"),
        F.first("pages").alias("pages"),
    )
    # -sum(p log p) to the base of the pages, from the sums of n and n log n.
    presentation = F.coalesce((F.log("total") - F.col("spread") / F.col("total")) / F.log("pages"), F.lit(0.0))
    kept = F.pow(F.lit(GAMMA), F.coalesce("orders", F.lit(1)))
    importance = (1 - kept) * presentation + kept * F.coalesce("content", F.lit(1.0))
    return nodes.select("site", "node", F.greatest(importance, F.coalesce("content", F.lit(0.0))).alias("importance"))


def page_text(html: str, low: set[int]) -> str:
    blocks, _ = read_page(html)
    return "\n".join(text for path, main, text in blocks if main or not low or _hash(path) not in low)


def _extract(low: dict[int, set[int]] | None):
    """``low``: by site; null if each row brings its own in ``low``."""

    def run(batches):
        for batch in batches:
            urls, pages = batch.column("url").to_pylist(), batch.column("html").to_pylist()
            own = batch.column("low").to_pylist() if low is None else None
            texts = []
            for i, (url, html) in enumerate(zip(urls, pages)):
                marks = set(own[i] or ()) if own is not None else low.get(_hash(host(url)), set()) if low else set()
                texts.append(page_text(html, marks))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["key", "url", "text", "n_chars"],
            )

    return run


def extract_main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """``<id>, url, text, n_chars`` of every row.

    Blocks are joined by a line break, white space inside them is one space, references are decoded.
    Null and empty pages have an empty text; pages without a host (a null URL, for one) are compared
    with no others; null ids and repeated rows keep a row each; other columns are not looked at.
    """
    kind = pages.schema[id_column].dataType.simpleString()
    rows = pages.select(F.col(id_column).alias("key"), F.col(url_column).alias("url"), text_of(html_column).alias("html"))
    tree = style_tree(rows.select("url", "html"))
    low = stored(tree.where(F.col("importance") < LEAST_IMPORTANCE).select("site", "node"), "low-branches")
    fields = f"key {kind}, url string, text string, n_chars long"
    if low.count() <= MOST_BROADCAST:
        by_site: dict[int, set[int]] = {}
        for site, node in low.collect():
            by_site.setdefault(site, set()).add(node)
        result = rows.mapInArrow(_extract(by_site), fields)
    else:
        branches = low.groupBy("site").agg(F.collect_set("node").alias("low"))
        sites = rows.mapInArrow(_with_site, f"key {kind}, url string, html string, site long")
        result = sites.join(branches, "site", "left").select("key", "url", "html", "low").mapInArrow(_extract(None), fields)
    return result.withColumnRenamed("key", id_column)


def _with_site(batches):
    for batch in batches:
        sites = pa.array([_hash(host(url)) for url in batch.column("url").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, sites], [*batch.schema.names, "site"])
