"""HTML extraction by removal of site templates.

A page is read into a tree. Each element's subtree gets a hash of its tag, class,
text and children. Spark counts, for every host, on how many pages with different text
a subtree stands; those on LEAST_PAGES or more are the site's template and are deleted.
Where a page has an article (a main element), every kind of element around it can be template,
down to a line of a list; in it, and on pages without one, only containers can, as sites
quote themselves. What differs from page to page, such as adverts and comments, and the
templates of hosts with few pages can't be counted: for these, elements go that say by
tag, class or role that they aren't the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .words import _digest, give_back

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("html head body caption td th tr tbody thead tfoot legend option summary figcaption dt dd li".split())
CONTAINER = frozenset("aside div dl fieldset footer form header menu nav ol section table ul".split())
# Of these, one that opens ends one of the same list that is open, up to the container named last.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("head script style noscript template svg canvas iframe object nav footer aside form button select textarea dialog menu title audio video math".split())
NEVER_TEXT = frozenset("head script style noscript template svg canvas iframe object form button select textarea title audio video math".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup comment comments disqus discussion replies respond sidebar widget related recommended share sharing social menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer toolbar pagination pager".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MAIN_WORDS = frozenset("article content post entry story maincontent".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
BROKEN = re.compile(r"<[a-zA-Z/!?]")
WORD = re.compile(r"[a-z]+")
#: Pages of a host with different text on which a subtree stands to be template, however many pages the host has.
LEAST_PAGES = 4


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    noise: bool = False
    main: str = ""
    label: str = ""
    parts: list[str] = field(default_factory=list)
    name: int = 0
    holds_main: bool = False
    has_text: bool = False


def _marks(tag: str, attributes: str, inside_main: bool) -> tuple[bool, str, str]:
    """Whether an element is no part of an article, which kind of main element it is, and its class."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    words = set(WORD.findall(found.get("class", "") + " " + found.get("id", "")))
    role = found.get("role", "")
    noise = tag in NOISE_TAGS or (tag == "header" and not inside_main) or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
    if tag not in ("html", "body", "article", "main") or words & {"comment", "comments"}:
        noise = noise or bool(words & NOISE_WORDS)
    if tag == "article" or role == "article":
        main = "article"
    elif tag == "main" or role == "main":
        main = "main"
    else:
        main = "content" if tag in ("div", "section") and words & MAIN_WORDS else ""
    return noise, main, found.get("class", "")


class Page:
    """nodes, and the text as (node, piece); a piece None ends a block."""

    def __init__(self, html: str | None):
        self.nodes = [Node("#root", -1)]
        self.pieces: list[tuple[int, str | None]] = []
        self._open = [0]
        html, at = html or "", 0
        while m := TAG.search(html, at):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3] or "")
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                stop = close.start() if close else len(html)
                self.nodes[self._open[-1]].parts.append(html[at:stop])
                at = stop
                if not close:
                    break
        rest = html[at:]
        if broken := BROKEN.search(rest):
            rest = rest[: broken.start()]
        if rest:
            self._text(rest)
        while len(self._open) > 1:
            self._close()
        self._close()

    def _text(self, text: str) -> None:
        text = unescape(text) if "&" in text else text
        self.pieces.append((self._open[-1], text))
        if text.strip():
            self.nodes[self._open[-1]].parts.append(" ".join(text.split()))
            self.nodes[self._open[-1]].has_text = True

    def _break(self) -> None:
        self.pieces.append((self._open[-1], None))

    def _close(self) -> None:
        at = self._open.pop()
        node = self.nodes[at]
        node.name = _digest("\x00".join([node.tag, node.label, *node.parts]).encode(errors="replace")) >> 1
        if node.parent >= 0:
            above = self.nodes[node.parent]
            above.parts.append(f"\x01{node.name}")
            above.has_text = above.has_text or node.has_text
            above.holds_main = above.holds_main or node.holds_main or bool(node.main)
        node.parts = []

    def _upto(self, tags: set[str], stops: frozenset[str] | set[str]) -> bool:
        """Closes the innermost open element of `tags`, if none of `stops` lies above it."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.nodes[self._open[k]].tag
            if tag in tags:
                while len(self._open) > k:
                    self._close()
                return True
            if tag in stops:
                return False
        return False

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._break()
        if tag in ENDS_P:
            self._upto({"p"}, CONTAINER | {"article", "main", "body", "td", "th", "li", "blockquote"})
        if tag in SIBLINGS:
            self._upto(*SIBLINGS[tag])
        if tag in VOID:
            if tag == "br":
                self.pieces.append((self._open[-1], " "))
            return
        above = self.nodes[self._open[-1]]
        noise, main, label = _marks(tag, attributes, bool(above.main))
        self.nodes.append(Node(tag, self._open[-1], above.noise or noise, main or above.main, label))
        if not main:
            self.nodes[-1].holds_main = False
        self._open.append(len(self.nodes) - 1)
        if tag in BLOCK:
            self._break()

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._break()
        if self._upto({tag}, frozenset()) and tag in BLOCK:
            self._break()

    def _could_be(self, x: Node) -> bool:
        """Whether an element could be template: one with text that neither is nor holds a main element; other kinds than containers only outside of one."""
        if x.parent < 0 or not x.has_text or x.holds_main or (x.main and not self.nodes[x.parent].main):
            return False
        return x.tag in CONTAINER or (not x.main and self.nodes[0].holds_main)

    def subtrees(self) -> set[int]:
        """Names of the elements that could be template."""
        return {x.name for x in self.nodes if self._could_be(x)}

    def text(self, template: set[int] | frozenset[int] = frozenset(), rules: bool = True) -> str:
        """Blocks of the article, one space between words and blocks; without `rules`, only the template and what is never text (scripts, forms, media) goes."""
        gone = [False] * len(self.nodes)
        for k, x in enumerate(self.nodes):
            own = x.name in template and self._could_be(x)
            gone[k] = own or (x.noise if rules else x.tag in NEVER_TEXT) or (x.parent >= 0 and gone[x.parent])
        kinds = {x.main for k, x in enumerate(self.nodes) if not gone[k]}
        kind = next((k for k in ("article", "main", "content") if k in kinds), "")
        inside = [False] * len(self.nodes)
        for k, x in enumerate(self.nodes):
            inside[k] = not kind or x.main == kind or (x.parent >= 0 and inside[x.parent])
        return " ".join("".join([" " if p is None else p for k, p in self.pieces if p is None or (inside[k] and not gone[k])]).split())


def _outline(html: str | None) -> tuple[int, list[int]]:
    """The name of a page's whole tree, and those of the elements that could be template."""
    page = Page(html)
    return page.nodes[0].name, list(page.subtrees())


def host_of(url: F.Column) -> F.Column:
    """The host in lower case, without its port; empty if the url has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract_text(pages: DataFrame, least: int = LEAST_PAGES, rules: bool = True) -> DataFrame:
    """page_id, url, text and n_chars for each page.

    pages needs page_id, url and html; other columns are dropped. Null or empty html gives an
    empty text. A null url has the empty host, one host like any other. Repeated pages count once
    for the template and each gives its row. A page is held whole in one worker.
    """
    rows = pages.select("page_id", "url", "html").withColumn("_host", host_of(F.col("url")))
    rows = rows.withColumns({"_row": F.xxhash64("_host", "html"), "_again": F.xxhash64(F.lit(7), "html", "_host")})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One tree at a time: a batch of them would take many times the batch's own memory.
            got = [_outline(x) for x in batch["html"]]
            yield pd.DataFrame({"_host": batch["_host"], "_row": batch["_row"], "_again": batch["_again"], "whole": [x[0] for x in got], "names": [x[1] for x in got]})
            give_back()

    trees = rows.select("_host", "_row", "_again", "html").mapInPandas(read, "_host string, _row long, _again long, whole long, names array<long>")
    trees = cut(trees, "trees")
    one = trees.groupBy("_host", "whole").agg(F.first("names").alias("names"))
    each = one.select("_host", "whole", F.explode("names").alias("name"))
    often = each.groupBy("_host", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("_host", "name")
    # Written: a menu that all pages of a large site have meets a plain table, by broadcast or split over tasks. A page's own subtrees bound what is collected for it.
    hits = each.join(cut(often, "templates"), ["_host", "name"]).groupBy("_host", "whole").agg(F.collect_set("name").alias("template"))
    hits = trees.select("_host", "whole", "_row", "_again").distinct().join(hits, ["_host", "whole"])
    hits = cut(hits.dropDuplicates(["_row", "_again"]).select("_row", "_again", "template"), "page-templates")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [Page(x).text(set(t) if t is not None else frozenset(), rules) for x, t in zip(batch["html"], batch["template"], strict=True)]
            give_back()
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").array, "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    joined = rows.join(hits, ["_row", "_again"], "left").select("page_id", "url", "html", "template")
    return joined.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
