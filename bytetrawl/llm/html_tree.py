"""Main text of pages by site style trees.

The pages of a host are merged to a tree of element paths. Each path has the presentations (sequences of child elements) and the
contents that its pages show there; their entropies, to the base of the number of pages, say how much the branch differs from page to
page. The importance of a branch is that entropy, drawn towards 1 where few pages have it, times a prior weight by what the pages
say about it: elements that are or are named as menus, footers, adverts and the like, and what stands outside of a marked article,
have a low weight, and what stands in the article has a high one. Branches of low importance are removed from each of the host's pages, in
articles too. Pages that are copies or near-copies of each other count once.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled, prepare, written

#: Branches below IMPORTANCE are removed. A branch's entropy counts as 1 on FREE more pages than there are.
IMPORTANCE, FREE = 0.3, 2
#: Prior weights: noise and what is outside of a marked article, elements whose names hint at noise, others, what is in an article, and
#: the article itself with all that it stands in, which stay.
NOISE, HINT, PLAIN, ARTICLE, KEPT = 0.15, 0.6, 1.0, 3.0, 1e9
#: Removal lists of at most so many bytes are broadcast; longer ones are joined by shuffling.
BROADCAST_BYTES = 2 << 20

#: Elements by their role in a page, and words in class, id and role that mark noise.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg canvas object textarea select title head".split())
_NOISE = frozenset("nav footer header aside form menu dialog button".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details div dl dd dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption tr".split())
#: Words that say in a class, id or role what an element is; whole names of noise, words that begin or end such names, words
#: that only hint at it, words that take a name's meaning back, and names of content, which outweigh the others.
_NAMES = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side-bar widget footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup sign-up login comments commentlist comment-list respond replies discussion disqus contentinfo complementary skip-link skiplink toc share sharing social search related recommended".split())
_WORDS = frozenset("ad ads advert adverts sponsor promo banner nav navbar navigation menu breadcrumb breadcrumbs pagination sidebar widget footer masthead topbar toolbar cookie cookies consent popup modal newsletter subscribe signup login comment comments replies disqus share sharing social".split())
_HINTS = frozenset("header head notice notices alert disclaimer comment reply search related recommended results toc list links tags meta".split())
_NOT = frozenset("no not has have with without hide hidden is js".split())
_CONTENT = frozenset("content article post entry story main text body page site entry-content post-content article-body post-body article-content main-content hentry".split())
_TAG = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = str.split
_CLASSY = re.compile(r"class|id\s*=|role|hidden", re.I)


def said(names: str) -> int:
    """What the names of an element say: 2 that it is noise, 1 that it could be, 0 nothing of the kind."""
    tokens = names.lower().split()
    if any(t in _CONTENT for t in tokens):
        return 0
    level = 0
    for t in tokens:
        words = re.split(r"[-_]+", t)
        if words[0] in _NOT:
            continue
        if t in _NAMES or words[0] in _WORDS or words[-1] in _WORDS:
            return 2
        if any(w in _HINTS for w in words):
            level = 1
    return level


@dataclass
class _Node:
    tag: str
    path: int
    noise: int
    main: bool
    text: int  # where its blocks begin
    comments: bool = False
    holds_main: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """blocks: (text, paths above); nodes: (path, style, content, weight) of each branch but the paragraphs of an article, style 0 where it has no elements."""

    blocks: list[tuple[str, tuple[int, ...]]] = field(default_factory=list)
    nodes: list[tuple[int, int, int, float]] = field(default_factory=list)


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def parse(source: str, decode: bool = True) -> Page:
    """The blocks and element nodes of a page, in order. Unclosed and stray tags are borne. decode: without it, blocks are as in the source."""
    page = Page()
    stack = [_Node("#", 0, 0, False, 0)]
    hashes: list[int] = []
    parts: list[str] = []
    raw_nodes: list[tuple[int, int, int, _Node]] = []
    has_main = False

    def flush() -> None:
        if parts:
            raw = "".join(parts)
            parts.clear()
            text = " ".join(_SPLIT(html.unescape(raw) if "&" in raw else raw)) if decode else raw.strip()
            if text:
                top = stack[-1]
                paths = tuple(n.path for n in stack)
                h = _crc(text)
                if top.tag not in _TEXTUAL:  # loose text is a branch of its own
                    loose = _Node("#text", _crc(f"{top.path}/#text"), top.noise, top.main, len(hashes))
                    raw_nodes.append((loose.path, 0, h, loose))
                    paths += (loose.path,)
                page.blocks.append((text, paths))
                hashes.append(h)

    def pop() -> None:
        flush()
        n = stack.pop()
        if n.tag not in _TEXTUAL or not n.main:
            style = _crc(" ".join(n.children)) if n.children else 0
            raw_nodes.append((n.path, style, _crc(repr(hashes[n.text :])), n))

    at, n = 0, len(source)
    while m := _TAG.search(source, at):
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group() == "<!--":
                end = source.find("-->", at)
                at = n if end < 0 else end + 3
            continue
        tag = m.group(2).lower()
        if m.group(1):
            if tag in _INLINE or tag in _VOID:
                continue
            if any(s.tag == tag for s in stack[1:]):
                while stack[-1].tag != tag:
                    pop()
                pop()
            else:
                flush()
            continue
        if tag in _RAW:
            if not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if tag == "head" and not end:
                    continue
                at = n if end is None else end.end()
            if tag not in ("script", "style", "noscript", "template"):
                flush()
            continue
        if tag in _INLINE or tag in _VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        flush()
        if tag in _CLOSES_P and stack[-1].tag == "p":
            pop()
        if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and stack[-1].tag == tag:
            pop()
        up = stack[-1]
        up.children.append(tag)
        mark, names, role, hidden = "", "", "", False
        if _CLASSY.search(m.group(3)):
            for a in _ATTRIBUTE.finditer(m.group(3)):
                name, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    hidden = True
                elif name in ("class", "id", "role"):
                    mark += f" {name}={value}"
                    names += f" {value}"
                    role = value.lower() if name == "role" else role
        own = said(names) if names and tag not in ("html", "body", "main") else 0
        comments = up.comments or own > 0 and any(re.match("comment|repl(y|ies)|respond|disqus", w) for w in re.split(r"[\s_-]+", names.lower()))
        if hidden or tag in _NOISE and not (tag == "header" and up.main and not own):
            own = 2
        if tag == "article" and own == 1:
            own = 2  # an article that is marked as a comment or a teaser
        article = own < 2 and not comments and (tag in ("article", "main") or role == "main")
        # An article stands for itself, whatever its wrappers are called.
        noise = own if article else max(own, up.noise)
        main = noise < 2 and (up.main or article)
        if article:
            has_main = True
            for s in stack:
                s.holds_main = True
        stack.append(_Node(tag, _crc(f"{up.path}/{tag}{mark}"), noise, main, len(hashes), comments, article))
    if at < n:
        parts.append(source[at:])
    while len(stack) > 1:
        pop()
    flush()
    for path, style, content, node in raw_nodes:
        outside = has_main and not node.main and not node.holds_main
        page.nodes.append((path, style, content, KEPT if node.holds_main else NOISE if node.noise == 2 or outside else ARTICLE if node.main else HINT if node.noise else PLAIN))
    return page


def seen_once(page: Page) -> dict[int, tuple[int, int, float]]:
    """Of each path of a page its presentation, content and least weight; what several branches with one path show is taken together."""
    out: dict[int, tuple[int, int, float]] = {}
    for path, style, content, weight in page.nodes:
        old = out.get(path)
        out[path] = (style, content, weight) if old is None else ((old[0] * 31 + style) & 0x7FFFFFFF, (old[1] * 31 + content) & 0x7FFFFFFF, min(old[2], weight))
    return out


def near_key(page: Page) -> int:
    """The same number for copies and most near-copies of a page: of its two long blocks with the smallest hashes, or of all blocks."""
    long = sorted({_crc(t) for t, _ in page.blocks if len(t) >= 80})
    return _crc(repr(long[:2] if long else [t for t, _ in page.blocks]))


def own_low(page: Page) -> frozenset[int]:
    """The branches of low importance of a page by itself, by their weights alone."""
    return frozenset(p for p, (_, _, w) in seen_once(page).items() if w < IMPORTANCE)


def main_text(page: Page, removed: frozenset[int] | None = None) -> str:
    """The blocks of a page that stand in no removed branch, between blank lines; by default a page is judged by itself."""
    removed = own_low(page) if removed is None else removed
    return "\n\n".join(t for t, above in page.blocks if removed.isdisjoint(above))


def host(url: str | None) -> str | None:
    try:
        return (urlsplit(url).hostname or "") if url else None
    except ValueError:
        return None


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of every branch of every host's style tree; url without a host are left out."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            rows = []
            for url, source in zip(pdf["url"], pdf["html"], strict=True):
                h = host(url)
                if h and source:
                    page = parse(source, decode=False)
                    key = near_key(page)
                    rows += [(h, path, style, content, weight, key) for path, (style, content, weight) in seen_once(page).items()]
            yield pd.DataFrame(rows, columns=["host", "path", "style", "content", "weight", "page"])

    seen = pages.select("url", "html").mapInPandas(nodes, "host string, path long, style long, content long, weight double, page long")
    # Near-copies that show the same there count once.
    kinds = written(seen.distinct().groupBy("host", "path", "style", "content").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "nodes")

    def entropy(by: str) -> DataFrame:
        """1 - sum(n log n) / (m log m): the entropy of the n to the base of their sum m."""
        n = F.col("n")
        k = kinds.groupBy("host", "path", by).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
        k = k.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum("weight").alias("weight"), F.sum(n * F.log(n)).alias("x"), F.max(by).alias("most"))
        h = F.when(F.col("pages") > 1, 1 - F.col("x") / (F.col("pages") * F.log(F.greatest("pages", F.lit(2))))).otherwise(1.0)
        return k.select("host", "path", "pages", (F.col("weight") / F.col("pages")).alias("weight"), h.alias(f"{by}_entropy"), (F.col("most") == 0).alias("leaf"))

    both = entropy("style").join(entropy("content").select("host", "path", "content_entropy"), ["host", "path"])
    h = F.when(F.col("leaf"), F.col("content_entropy")).otherwise((F.col("style_entropy") + F.col("content_entropy")) / 2)
    return both.select("host", "path", "pages", (F.col("weight") * (F.col("pages") * h + FREE) / (F.col("pages") + FREE)).alias("importance"))


def low_importance(pages: DataFrame) -> DataFrame:
    """(host, path) of the branches that are removed from a host's pages."""
    return importance(pages).where(F.col("importance") < IMPORTANCE).select("host", "path")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    Null html and html without text give an empty text. A page whose url is null or has no host is judged by its own weights. Null page_ids,
    ties and repeated rows are kept, other columns are left out and may have any name, and long pages are parsed whole. An empty table
    gives an empty table.
    """
    spark = pages.sparkSession
    prepare(spark)
    of = pages.select("page_id", "url", "html")
    removal = written(low_importance(of).groupBy("host").agg(F.collect_list("path").alias("removed")), "removal")
    n, hosts = removal.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0)), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def of_url(url: pd.Series) -> pd.Series:
        return pd.Series([host(u) for u in url], dtype=object)

    side = F.broadcast(removal) if 8 * n + hosts <= BROADCAST_BYTES else removal
    of = of.withColumn("own", of_url("url")).join(side, F.col("own") == F.col("host"), "left").select("page_id", "url", "html", "own", "removed")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filled(batches):
            texts = []
            for source, h, removed in zip(pdf["html"], pdf["own"], pdf["removed"], strict=True):
                page = parse(source) if source else Page()
                texts.append(main_text(page, frozenset(map(int, removed)) if removed is not None else frozenset() if h else None))
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64").to_numpy(dtype=object, na_value=None), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return of.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
