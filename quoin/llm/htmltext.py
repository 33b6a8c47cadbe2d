"""Main text of web pages, without what a site repeats on its pages.

Each page is parsed into a tree. Blocks outside the article, and containers (div, section, list, table) in it,
are hashed and counted per host in Spark; those that recur on many pages of the host are its template and go,
whatever they look like. What tells itself by tag, role or class to be a menu, header, footer, sidebar, notice,
advert, form or comment goes too.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stored, table

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_GONE = {"script", "style", "noscript", "template", "iframe", "nav", "footer", "aside", "form", "button", "input", "select", "textarea", "menu", "dialog", "svg", "canvas", "object", "head", "title", "option", "label", "audio", "video"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of class and id that tell what isn't the article; compared with whole parts between - and _.
_STRONG = set("ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion nav navbar navigation menu submenu topbar breadcrumb breadcrumbs crumbs pagination pager masthead footer sidebar widget widgets newsletter subscribe subscription signup login cookie cookies consent gdpr popup modal paywall comment comments commentlist replies respond disqus share sharing social toolbar searchbox siteheader sitefooter".split())
#: These tell it only where nothing else is named beside them.
_WEAK = set("banner header side aside rail related recommended recommendations trending popular notice notices alert overlay disclaimer copyright reply discussion search form tags hidden".split())
_NEUTRAL = set("site page main global top bottom left right upper lower inner outer primary secondary box bar block area section container wrapper wrap list item items entry link links button buttons icon icons text body content col column row grid panel group media feed message msg post posts article articles js is has no the id class".split())
#: Containers, which one such word among others marks.
_MARKED = {"address", "aside", "blockquote", "center", "dd", "details", "div", "dl", "dt", "figure", "header", "hgroup", "li", "ol", "section", "table", "tbody", "td", "tr", "ul"}
_CONTENT = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|main|body|text)(?=$|[\s_-])", re.I)
#: Blocks that can be template inside the article; a repeated paragraph, heading or quotation is its own.
_BOXES = {"div", "section", "ul", "ol", "dl", "table", "details", "figure", "center", "fieldset", "address", "hgroup", "header"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends that goes on at `at`: behind its > outside quotes. A quote that is not closed before the next < is none."""
    n = len(page)
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        tag = page.find("<", m.end())
        close = page.find(m[0], m.end(), tag if tag >= 0 else n)
        at = close + 1 if close >= 0 else m.end()
    return n


def parse(page: str) -> Node:
    """A tree of elements and strings (references decoded); end tags that are missing or astray are made up for."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(page)
    count: dict = {}  # open elements by tag

    def close(i: int) -> None:
        for x in stack[i:]:
            count[x.tag] -= 1
        del stack[i:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        m = _NAME.match(page, lt)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?", "/") and lt < n:  # a < that opens nothing
            nxt = page.find("<", lt + 1)
            nxt = n if nxt < 0 else nxt
            stack[-1].kids.append(html.unescape(page[at:nxt]))
            at = nxt
            continue
        if lt > at:
            stack[-1].kids.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        if not m:
            ends = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">"))
            first, last = next(x for x in ends if page.startswith(x[0], lt))
            end = page.find(last, lt + len(first))
            at = n if end < 0 else end + len(last)
            continue
        at = _tag_end(page, m.end())
        if m[0][1] == "/":
            tag = m[0][2:].lower()
            if count.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in _BLOCK and tag not in _BLOCK:
                        break
            continue
        tag, inner = m[0][1:].lower(), page[m.end() : at].rstrip(">")
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(inner)} if inner.strip(" /\t\r\n") else {}
        if tag in _BLOCK and count.get("p"):  # a block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _CLOSES and any(count.get(x) for x in _CLOSES[tag][0]):
            ends, within = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in _RAW:
            end = _raw_end(tag).search(page, at)
            a, at = at, end.end() if end else n
            node.kids.append(page[a : end.start() if end else n])
        elif tag not in _VOID and not inner.endswith("/"):
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
    return root


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I)


def events(root: Node):
    """The tree in page order, without recursion: (0, element) where it begins, (1, string), (2, element) where it ends."""
    stack = [(root, iter(root.kids))]
    yield 0, root
    while stack:
        node, rest = stack[-1]
        for k in rest:
            if isinstance(k, str):
                yield 1, k
            else:
                yield 0, k
                stack.append((k, iter(k.kids)))
                break
        else:
            stack.pop()
            yield 2, node


@lru_cache(maxsize=4096)
def says_boilerplate(names: str, container: bool = True) -> bool:
    """Whether a class or id names what isn't the article: a word such as ad, sidebar or site-footer; or a word such
    as notice or search, if there is nothing else but words of layout. Of a paragraph or an inline element nothing
    else may be said."""
    strong, weak, only = False, False, True
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_]+|(?<=\D)(?=\d)", name) if x and not x.isdigit()]
        known = all(x in _STRONG or x in _WEAK or x in _NEUTRAL for x in parts)
        strong |= known and any(x in _STRONG for x in parts)
        weak |= known and any(x in _WEAK for x in parts)
        only &= known
    return (strong and (only or container)) or (weak and only and container)


def is_boilerplate(node: Node, in_article: bool) -> bool:
    """By tag, role, class or id; a header inside the article is part of it."""
    if node.tag in _GONE or (node.tag == "header" and not in_article):
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if a.get("role", "").lower() in _ROLES and not (in_article and a["role"].lower() == "banner"):
        return True
    if node.tag in _HEADINGS or (in_article and node.tag == "header"):
        return False
    return any(says_boilerplate(a[k], node.tag in _MARKED) for k in ("class", "id") if k in a)


def article_kind(node: Node) -> int:
    """How sure an element holds the article: article, main, role=main, a block named like content; 0 for none."""
    if node.tag == "article":
        return 0 if is_comment(node) else 4
    if node.tag == "main":
        return 3
    if node.attrs.get("role") == "main":
        return 2
    return 1 if node.attrs and node.tag in ("div", "section", "td") and _CONTENT.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}") else 0


def is_comment(node: Node) -> bool:
    return bool(re.search(r"comment|reply|related|teaser", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}", re.I))


class Page:
    """A page's tree with what its elements say of themselves: ids of elements that are gone, and of the outermost
    ones of the surest kind that is left with text. All of these are the article, in page order."""

    def __init__(self, root: Node, template: dict | None = None):
        self.root, self.gone, self.tops = root, set(), set()
        found: dict = {}  # kind: elements
        path: list = []  # (gone, kind) of open elements
        text: list = []  # characters of found elements that are open
        self.sizes: dict = {}
        for what, x in events(root):
            if what == 0:
                gone, kinds = path[-1] if path else (False, ())
                out = is_boilerplate(x, bool(kinds)) or bool(template and id(x) in template)
                if out:
                    self.gone.add(id(x))
                kind = 0 if gone or out else article_kind(x)
                if kind and kind not in kinds:
                    found.setdefault(kind, []).append(id(x))
                path.append((gone or out, (*kinds, kind) if kind and kind not in kinds else kinds))
                text.append(0)
            elif what == 2:
                path.pop()
                n = text.pop()
                if text:
                    text[-1] += n
                self.sizes[id(x)] = n
            elif not path[-1][0] and not x.isspace():
                text[-1] += 1
        for kind in sorted(found, reverse=True):
            if some := [i for i in found[kind] if self.sizes[i]]:
                self.tops = set(some)
                break


def _is_box(node: Node) -> bool:
    """A container in the article; a plain div or section without blocks is a paragraph."""
    if node.tag not in _BOXES:
        return False
    return node.tag not in ("div", "section") or any(node.attrs.get(a) for a in ("class", "id", "role")) or any(isinstance(k, Node) and k.tag in _BLOCK for k in node.kids)


def subtree_hashes(page: Page) -> tuple[dict, list[str]]:
    """By id(element), a hash of each block with text that is outside the article and does not hold it, or is a box
    in it; with the words (from, to) of the article that a box in it spans, else None. And the article's words."""
    out: dict = {}
    words: list[str] = []
    stack: list = []  # open elements: hash, first word, in the article, kept, holds the article, has text
    for what, x in events(page.root):
        if what == 0:
            top = id(x) in page.tops
            above = stack[-1] if stack else None
            inside = bool(above and (above[2] or above[6]))
            kept = (above is None or above[3]) and not (inside and id(x) in page.gone)
            h = hashlib.blake2b(x.tag.encode() + b"\0" + x.attrs.get("class", "").encode("utf-8", "replace"), digest_size=8)
            stack.append([h, len(words), inside, kept, top, False, top])
        elif what == 1:
            if part := x.split():
                own = stack[-1]
                own[0].update(b"\1" + " ".join(part).encode("utf-8", "replace"))
                own[5] = True
                if (own[2] or own[6]) and own[3]:
                    words.extend(part)
        else:
            h, at, inside, kept, holds, some, _ = stack.pop()
            digest = h.digest()
            if some and not holds and (kept and _is_box(x) if inside else x.tag in _BLOCK and x.tag not in ("html", "body")):
                out[id(x)] = int.from_bytes(digest, "big", signed=True), (at, len(words)) if inside else None
            if stack:
                stack[-1][0].update(b"\2" + digest)
                stack[-1][4] |= holds
                stack[-1][5] |= some
    return out, words


def counted_hashes(page: Page) -> list[tuple[int, int | None]]:
    """The hashes of a page, each once, with a trait of what else the article says; None for blocks outside it.

    The trait is the least hash of three words in a row outside the box. Copies and near copies of an article
    nearly always share it, so that what they repeat isn't taken for what a site puts into all of its articles.
    """
    found, words = subtree_hashes(page)
    out: dict = {}
    if any(span for _, span in found.values()):
        n, top = len(words), 1 << 32
        threes = [zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(n)]
        before, after = [top], [top] * (n + 1)  # least of the first i; least from i on
        for x in threes:
            before.append(min(before[-1], x))
        for i in range(n - 1, -1, -1):
            after[i] = min(after[i + 1], threes[i])
    for h, span in found.values():
        trait = None
        if span:
            trait = min(before[max(0, span[0] - 2)], after[span[1]])
            if 0 < span[0] < 3:
                trait = min(trait, zlib.crc32(" ".join(words[: span[0]]).encode("utf-8", "replace")))
        out[h] = None if trait is None or out.get(h, trait) is None else min(trait, out.get(h, trait))
    return sorted(out.items(), key=lambda x: x[0])


def main_text(html_text: str, template: set = frozenset()) -> str:
    """Blocks of the article (or of the page, where none shows) joined by two line ends, without template subtrees.

    These go first, whatever they look like; the article is found in what is left.
    """
    page = Page(parse(html_text))
    if template:
        page = Page(page.root, {i for i, (h, _) in subtree_hashes(page)[0].items() if h in template})
    blocks, line = [], []
    whole = not page.tops
    depth = hidden = 0  # open tops; open elements that are gone

    def flush() -> None:
        if part := " ".join("".join(line).split()):
            blocks.append(part)
        line.clear()

    for what, x in events(page.root):
        if what == 1:
            if not hidden and (whole or depth):
                line.append(x)
            continue
        step = 1 - what
        if x.tag in _BLOCK or id(x) in page.tops:
            flush()
        elif x.tag == "br" and what == 0:
            line.append(" ")
        if id(x) in page.tops:
            depth += step
        if id(x) in page.gone:
            hidden += step
    flush()
    return "\n\n".join(blocks)


def host_of(url):
    """The host of a URL column in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, least_pages: int = 5, share: float = 0.05) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html).

    A block outside the article, or a box in it, is template where it recurs on at least least_pages pages and
    share of all pages of its host; if only inside articles, in least_pages that say different things besides.
    Null html is empty; pages without text have an empty one; a null or odd url counts as host ''. Repeated rows are pages of their own.
    """
    pages = pages.select("page_id", "url", "html")

    def hashes(b):
        lists = [counted_hashes(Page(parse(t or ""))) for t in b.column(1).to_pylist()]
        owner = [i for i, x in enumerate(lists) for _ in x]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array([h for x in lists for h, _ in x], pa.int64()), pa.array([t for x in lists for _, t in x], pa.int64())], names=["host", "h", "trait"])

    seen = map_arrow(pages.select(host_of(F.col("url")).alias("host"), "html"), hashes, "host string, h long, trait long")
    many = seen.groupBy("host", "h", "trait").count().groupBy("host", "h").agg(F.sum("count").alias("count"), F.count("trait").alias("traits"), F.sum(F.when(F.col("trait").isNull(), F.col("count")).otherwise(0)).alias("outside"))
    many = many.where((F.col("outside") >= least_pages) | (F.col("traits") >= least_pages))
    hosts = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))
    many = many.join(hosts, "host").where(F.col("count") >= share * F.col("pages")).select("host", "h")
    # At least `share` of a host's pages hold each of these, so that a host has few: a list a host.
    template = stored(many.groupBy("host").agg(F.array_sort(F.collect_list("h")).alias("template")), "html-templates")

    def texts(b):
        got = [main_text(page or "", set(known or ())) for page, known in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.withColumn("host", host_of(F.col("url"))).join(template, "host", "left").select("page_id", "url", "html", "template")
    return map_arrow(joined, texts, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
