"""HTML extraction with removal of site templates.

A page is read into its block elements. Each subtree of the whole page (tag, texts and subtrees below, in order) is
hashed, and Spark counts on how many of a host's pages with different content it stands. Those on at least MIN_PAGES
pages and MIN_SHARE of the host's pages are the site's template and are deleted, wherever they stand and whatever their
tags and names: menus, notices, footers, adverts that recur. Paragraphs and headings of a main part need MAIN_SHARE;
those of a marked article, which may quote or repeat each other, are never taken for template.

What a page has of its own goes by structure: elements for navigation, page headers and footers, asides, forms, scripts
and styles, and hidden ones. Class and id names are weak evidence: an element all of whose words name a menu, notice,
advert, sidebar or reader comments is left out unless it holds half of the text that is left or more (of comments, nine tenths). If the page marks
an article (or else a main part), only text inside it counts; a heading in an article's header stays.

Buttons, selects, svg, noscript and template elements are left out up to their end tag. If it doesn't come before the
block around them ends, only what stands up to the next block tag is. Script, style, title, textarea and iframe hold all
up to their end tag, or else the rest of the page, as HTML says; if closed in their own tag (<iframe/>), they are empty.
A "<" that begins no closed tag is text. Reading takes time in proportion to the page, whatever is left open in it.

Character references are decoded; white space (Unicode) inside a block becomes one blank; blocks are joined by line
feeds in page order. Null or empty html gives empty text. Pages without a url, or with one without a host, are those
of one host. Pages whose text is the same by structure count once. Extra columns pass through; those of the result's names
are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Tables, small_batches

MIN_PAGES, MIN_SHARE = 5, 0.2
#: The share that paragraphs and headings in a main part need.
MAIN_SHARE = 0.9
#: Subtrees of templates that are broadcast with their hosts; beyond, the join is shuffled.
BROADCAST_SUBTREES = 1_000_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Elements that hold raw text up to their end tag.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in "script style textarea title iframe".split()}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_NAME = re.compile("[a-z0-9]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html"
    " legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head".split()
)
CLOSE_PARAGRAPH = BLOCKS - frozenset("body caption dd dt head html legend li option summary tbody td tfoot th thead tr".split()) | {"li", "dd", "dt", "hr", "table"}
#: Tag, the open ones it ends, and those beyond which it doesn't look.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"form"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
DROPPED_TAGS = frozenset("nav footer aside form head dialog menu fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal"
    " overlay newsletter subscribe subscription sidebar related recommended share sharing social breadcrumb breadcrumbs menu nav navbar navigation"
    " comment comments reply replies disqus respond footer masthead toolbar pagination pager widget login signup search hidden".split()
)
#: A named element with this share of the text that is left, or more, is kept; of comments, which may be longer than the article, with this.
NAMED_SHARE, COMMENTS_SHARE = 0.5, 0.9
#: Words that may stand beside one of DROPPED_NAMES in a class name of several, such as main-nav or comment-list.
BESIDE = frozenset(
    "site page main top bottom left right inner outer wrapper wrap container box bar block area list item items section slot unit panel link links"
    " button buttons form posts post user primary secondary global mobile desktop header text 1 2 3".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies disqus".split())
MAIN_NAMES = frozenset("article post entry story content".split())
PROTECTED = HEADINGS | frozenset("p blockquote pre".split())
#: Elements within lines whose content is left out.
SKIPPED = frozenset("button select svg noscript template".split())
PAGE = 0
KINDS = ("article", "body", "main", "name")


class _Node:
    """`dropped`, `header`, `comment` and `open` hold for what is inside too; `mains` are the kinds of main part it is in, a bit each."""

    __slots__ = ("tag", "parent", "named", "own", "dropped", "header", "main", "mains", "comment", "open", "parts", "hash", "size", "template")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.parts, self.hash, self.size, self.template = tag, parent, [], 0, 0, False
        self.named = self.own = self.dropped = self.header = self.comment = False
        self.main, self.mains, self.open = "", 0, True


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault((m[1] or m[5]).lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


#: A token: kind ("text", "raw" for what leaves only a blank, "start" or "end"), then the text or the tag and its attributes.
_Token = tuple[str, str, str]


def _tokens(html: str) -> list[_Token]:
    """Each stretch of the page is looked at a bounded number of times: what has no end further on is looked for only once."""
    out: list[_Token] = []
    at, n, last = 0, len(html), html.rfind(">")
    tag_of, ends = _TAG, dict.fromkeys(_RAW_END, True)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            # Raw text and comments hold the rest of the page also where no tag is closed.
            if lt < 0 or not html.startswith("<!--", lt):
                out.append(("text", html[at:], ""))
                break
        if lt > at:
            out.append(("text", html[at:lt], ""))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            at = html.find(">", lt) + 1
            continue
        m = tag_of.match(html, lt)
        if m is None and tag_of is _TAG and _PLAIN_TAG.match(html, lt):
            # A quote that is never closed: from here on tags end at their first ">".
            tag_of = _PLAIN_TAG
            m = tag_of.match(html, lt)
        if m is None:
            out.append(("text", "<", ""))
            at = lt + 1
            continue
        tag, at = m[2].lower(), m.end()
        if tag in _RAW_END and not m[1]:
            out.append(("raw", "", ""))
            if not m[3].endswith("/"):
                end = _RAW_END[tag].search(html, at)
                at = end.end() if end else n
            continue
        out.append(("end" if m[1] else "start", tag, m[3]))
    return out


def _skipped_ends(tokens: list[_Token]) -> dict[int, int]:
    """Token of each outermost start of a skipped element -> that of its end; its own if the element is empty, -1 if it has none
    before the block around it ends."""
    found: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    last = lambda *tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)
    for i, (kind, tag, raw) in enumerate(tokens):
        if kind not in ("start", "end") or not (tag in SKIPPED or tag in BLOCKS):
            continue
        if kind == "start":
            if tag in SKIPPED:
                empty = raw.endswith("/")
                found[i] = i if empty else -1
                if empty and tag == "svg":
                    continue
            places.setdefault(tag, []).append(len(opened))
            opened.append((tag, i))
            continue
        at = last(tag)
        if at < 0 or (tag in SKIPPED and last("table", "td", "th", "caption") > at):
            continue
        if tag in SKIPPED:
            found[opened[at][1]] = i
        for t, _ in opened[at:]:
            places[t].pop()
        del opened[at:]
    return found


class Page:
    """The block elements of a page and its blocks of text, in order."""

    def __init__(self, html: str):
        self.blocks: list[tuple[_Node, str]] = []
        self.nodes: list[_Node] = []
        self._text: list[str] = []
        self._stack: list[_Node] = [_Node("", None)]  # open elements, the page itself first
        self._open: dict[str, list[int]] = {}  # by tag: their places in the stack
        tokens = _tokens(html)
        ends = _skipped_ends(tokens) if any(t[1] in SKIPPED and t[0] == "start" for t in tokens) else {}
        upto, skipping = -1, False
        for i, (kind, tag, raw) in enumerate(tokens):
            if i <= upto:
                continue
            if kind == "text":
                self._text.append(" " if skipping else unescape(tag) if "&" in tag else tag)
            elif kind == "raw":
                self._text.append(" ")
            elif i in ends:
                self._text.append(" ")
                upto, skipping = ends[i], skipping or ends[i] < 0
            else:
                if tag in BLOCKS and tag != "option":
                    skipping = False
                if kind == "end":
                    self._end(tag)
                else:
                    self._start(tag, raw)
        self._flush()
        while self._stack:
            self._close()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.blocks.append((self._stack[-1], text))
                self._stack[-1].parts.append(text)
                self._stack[-1].size += len(text)

    def _close(self) -> None:
        node = self._stack.pop()
        if node.parts:
            node.hash = xxhash.xxh3_64_intdigest(f"{node.tag}\0" + "\0".join(node.parts)) >> 1 or 1
            node.parts.clear()
        if node.parent is not None:
            self._open[node.tag].pop()
            if node.hash:
                node.parent.parts.append(f"\1{node.hash:x}")
                node.parent.size += node.size

    def _last(self, tags) -> int:
        """The place of the innermost open element of `tags`; 0 if there is none."""
        return max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)

    def _close_down_to(self, place: int) -> None:
        while len(self._stack) > place:
            self._close()

    def _close_to(self, tags, stops=()) -> None:
        """Ends the outermost open element of `tags` above the nearest of `stops`."""
        stop, found = self._last(stops), []
        for t in tags:
            places = self._open.get(t) or []
            first = bisect_right(places, stop)
            found += places[first : first + 1]
        if found:
            self._close_down_to(min(found))

    def _start(self, tag: str, raw: str) -> None:
        if tag not in BLOCKS:
            if tag in ("br", "hr", "img", "input", "wbr"):
                if tag == "hr":
                    self._flush()
                    self._close_to(("p",), ("td", "th", "table"))
                elif tag == "br":
                    self._text.append(" ")
            return
        self._flush()
        if tag in ("html", "body"):
            return
        if tag in CLOSE_PARAGRAPH:
            self._close_to(("p",), ("td", "th", "table"))
        if tag in SIBLINGS:
            self._close_to(*SIBLINGS[tag])
        node = _Node(tag, self._stack[-1])
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(node)
        self.nodes.append(node)
        if tag in DROPPED_TAGS:
            node.own = True
        elif tag == "header":
            node.header = True
        if raw:
            self._mark(node, _attributes(raw))
        if tag == "article" and not node.comment:
            node.main = "article"
        elif tag == "main":
            node.main = node.main or "main"

    @staticmethod
    def _mark(node: _Node, attributes: dict[str, str]) -> None:
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
        names = [set(_NAME.findall(name)) for name in label.split()]
        role = attributes.get("role", "").lower()
        node.named = any(n & DROPPED_NAMES and n <= DROPPED_NAMES | BESIDE for n in names)
        node.comment = any(n & COMMENT_NAMES and n <= DROPPED_NAMES | BESIDE for n in names)
        if (
            role in DROPPED_ROLES
            or "hidden" in attributes
            or attributes.get("aria-hidden", "").lower() == "true"
            or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        ):
            node.own = True
        elif any("header" in n and n <= DROPPED_NAMES | BESIDE for n in names):
            node.header = True
        if attributes.get("itemprop") == "articleBody":
            node.main = "body"
        elif role == "main":
            node.main = "main"
        elif any(n & MAIN_NAMES for n in names):
            node.main = "name"

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text.append(" ")
        elif tag in BLOCKS:
            self._flush()
            places = self._open.get(tag)
            if places and (tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or places[-1] > self._last(("td", "th", "table"))):
                self._close_down_to(places[-1])

    def _flag(self, articles: bool) -> None:
        """Sets what holds inside an element too, parents first. With `articles`, an article counts also inside an element left open by
        mistake, and what is dropped above it isn't in it."""
        sizes = self._sizes()
        whole = sizes[id(self.root)]
        for n in self.nodes:
            p = n.parent
            own = n.own or (n.named and sizes[id(n)] < whole * (COMMENTS_SHARE if n.comment else NAMED_SHARE))
            top = p.parent is None
            n.open = top or (p.open and not (p.tag in DROPPED_TAGS and p.tag != "form") and not p.comment)
            n.comment = n.comment or p.comment
            n.header = n.header or p.header
            begins = articles and n.main == "article" and n.open and not n.comment
            n.dropped = n.tag in DROPPED_TAGS if begins else own or p.dropped
            n.mains = p.mains | (1 << KINDS.index(n.main) if n.main and not n.dropped and not (n.main == "article" and n.comment) else 0)

    def _sizes(self) -> dict[int, int]:
        """By element: the text in it that neither the template nor its own tags leave out."""
        found = {id(n): 0 for n in self.nodes}
        found[id(self.root)] = 0
        for n, text in self.blocks:
            if not n.template:
                found[id(n)] += len(text)
        for n in reversed(self.nodes):
            if not n.own:
                found[id(n.parent)] += found[id(n)]
        return found

    @property
    def root(self) -> _Node:
        return self.blocks[0][0] if not self.nodes else self.nodes[0].parent

    def keys(self) -> list[tuple[_Node, int]]:
        """What each subtree is counted by: its hash, negative for paragraphs and headings in a main part. Those of an article, and what a
        main part stands in, are never template."""
        self._flag(False)
        around: set[int] = set()
        for n in reversed(self.nodes):
            if n.main or id(n) in around:
                around.add(id(n.parent))
        free = lambda n: n.hash and not n.main and id(n) not in around and not (n.mains & 1 and n.tag in PROTECTED)
        return [(n, -n.hash if n.mains and n.tag in PROTECTED else n.hash) for n in self.nodes if free(n)]

    def delete(self, template) -> None:
        """Marks the subtrees whose keys are in `template`."""
        if not template:
            return
        marked = {id(n) for n, key in self.keys() if key in template}
        for n in self.nodes:
            n.template = n.parent.template or id(n) in marked

    def kept(self) -> list[tuple[_Node, str]]:
        """The blocks that neither the template nor structure leaves out."""
        if not self.blocks:
            return []
        self._flag(False)
        left = [(n, t) for n, t in self.blocks if not n.dropped and not n.template]
        for bit, kind in enumerate(KINDS):
            found = [(n, t) for n, t in left if n.mains >> bit & 1 and (not n.header or n.tag in HEADINGS)]
            if not found and kind == "article" and any(n.main == kind for n in self.nodes):
                self._flag(True)
                found = [(n, t) for n, t in self.blocks if not n.dropped and not n.template and n.mains & 1 and (not n.header or n.tag in HEADINGS)]
                if not found:
                    self._flag(False)
            # A name alone marks the main part only if it holds most of the text.
            if found and (kind != "name" or 2 * sum(len(t) for _, t in found) >= sum(len(t) for _, t in left)):
                return found
        return [(n, t) for n, t in left if not n.header]


def subtree_hashes(html: str | None) -> tuple[list[int], int]:
    """(keys of the page's subtrees, a hash of the text that structure leaves)."""
    page = Page(html or "")
    keys = list(dict.fromkeys(key for _, key in page.keys())) if page.blocks else []
    return keys, xxhash.xxh3_64_intdigest("\n".join(t for _, t in page.kept())) >> 1


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    page = Page(html or "")
    if page.blocks:
        page.delete(template)
    return "\n".join(t for _, t in page.kept())


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, subtrees, contents = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, content = subtree_hashes(html)
            hosts += [host] * (len(found) + 1)
            subtrees += [PAGE, *found]
            contents += [content] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(contents, pa.int64())], names=["host", "subtree", "content"])


def site_templates(pages: DataFrame, tables: Tables, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, html) -> (host, template): the subtrees to delete on the host's pages. A host's list is bounded by the
    subtrees of an average page over `min_share`."""
    rows = pages.select("host", "html").mapInArrow(_hash_batches, "host string, subtree long, content long").distinct()
    counts = tables.put("counts", rows.groupBy("host", "subtree").agg(F.count("*").alias("pages")).filter((F.col("pages") >= min_pages) | (F.col("subtree") == PAGE)))
    totals = counts.filter(F.col("subtree") == PAGE).select("host", F.col("pages").alias("total"))
    common = counts.filter(F.col("subtree") != PAGE).join(totals, "host")
    share = F.when(F.col("subtree") < 0, max(min_share, MAIN_SHARE)).otherwise(min_share)
    return common.filter(F.col("pages") >= F.col("total") * share).groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """`pages` (url, html) with `text`, the article's blocks, and n_chars, its code points."""
    named = pages.drop("text", "n_chars").withColumn("_host", host_of(F.col("url")))
    small_batches(pages.sparkSession)
    tables = Tables(pages.sparkSession, "html")
    templates = tables.put("templates", site_templates(named.select(F.col("_host").alias("host"), "html"), tables, min_pages, min_share))
    templates = templates.select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    if (templates.agg(F.sum(F.size("_template"))).first()[0] or 0) <= BROADCAST_SUBTREES:
        templates = F.broadcast(templates)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, template in batches:
            pairs = zip(html.to_pylist(), template.to_pylist(), strict=True)
            yield pa.array([main_text(h, frozenset(t or ())) for h, t in pairs], pa.string())

    out = named.join(templates, "_host", "left").withColumn("text", text_of("html", "_template"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).drop("_host", "_template")
