"""Main text of web pages, with site templates removed.

First pass: all block elements of a page, menus, headers, footers and adverts too,
are hashed as subtrees, and Spark counts on how many pages of its host each hash
occurs (pages of equal text once).  There are two hashes: of the subtree itself
(tag, class, id, texts, children), and, where most of its text is in links (three
or more), of its layout (tags, classes, where there is text, runs of like children
once): a site's menus recur in shape when their words do not.  A hash on at least
``MIN_PAGES`` pages and ``MIN_SHARE`` of its host's pages belongs to the site's
template.

Second pass: template subtrees are deleted first, the innermost before those around
them.  Of what is left, elements that are never article text go (menus, headers,
footers, sidebars, forms, scripts, styles; by tag, role, or a word of their class
or id also notices, adverts and reader comments).  Then the article is taken: all
outermost ``article`` elements that have text, else all ``main``, else the body.
``n_template``, ``n_layout`` and ``n_rules`` count the blocks that each way removed.

A host's template has at most (subtrees per page) / MIN_SHARE members, so one
row per host holds it; counts are aggregated map-side by (host, hash), and the
join by host is an ordinary one that adaptive execution can broadcast or split.

Blocks are trimmed, have their white space runs (``<br>`` included) turned
into one space and are joined by a line break; character references are
decoded; nothing is cut.  Work is in proportion to the page, however its elements
nest or are left open: the open elements of each tag are kept apart, so an end tag
never walks the others.

Defined results: a null or empty html gives an empty text; a null url has no
host, so only the fixed rules apply; unclosed, stray and cut-off tags are
tolerated; each input row gives one row, repeated page_ids too; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Tables, dealt_table, small_batches, stored

MIN_PAGES = 5
MIN_SHARE = 0.5
#: Links that make a block a menu, if half its text is in links.
MIN_LINKS = 3
BATCH_BYTES = 4 << 20

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
NEVER = frozenset(["nav", "aside", "footer", "form", "head", "svg", "button", "select", "menu", "dialog", "object", "audio", "video", "canvas"])
NEVER_ROLE = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"])
#: Words of a class or id that say what an element is for.
NEVER_WORD = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar
navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices notification popup modal overlay
newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus replies respond
pagination pager toolbar masthead""".split())
CLOSED_BY = {
    "p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
}
#: Elements beyond which an opening tag closes nothing.
SCOPE = frozenset(["ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "blockquote", "select", "td", "th"])
WHOLE = frozenset(["html", "body", "article", "main"])
#: By opening tag: what it closes, and beyond which open elements it closes nothing.
_CLOSES = {t: [c for c, by in CLOSED_BY.items() if t in by] for t in frozenset(x for v in CLOSED_BY.values() for x in v)}
_BARRIERS = {t: [x for x in sorted(SCOPE) if t not in CLOSED_BY.get(x, ())] for t in _CLOSES}
_ZEROS, _LONG_REF = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}+")
#: Seed that tells hashes of layouts from those of subtrees.
_LAYOUT = 1


def never(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is never part of the article."""
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not attrs or tag in WHOLE:
        return False
    for m in _ATTR.finditer(attrs):
        words = _WORD.findall((m[2] or m[3] or m[4] or "").lower())
        if m[1].lower() == "role":
            if NEVER_ROLE.intersection(words):
                return True
        elif NEVER_WORD.intersection(words) or "header" in words and not in_article:
            return True
    return False


def _label(tag: str, attrs: str) -> tuple[str, str]:
    """(tag with class, id and role, tag with classes)."""
    if not attrs:
        return tag, tag
    found = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)]
    return tag + "".join(f" {k}={v}" for k, v in found), tag + "".join(f" {v}" for k, v in found if k == "class")


def unescape(text: str) -> str:
    """Character references decoded, decimal ones of any length too."""
    if "&#" in text:
        text = _LONG_REF.sub("&#1114112", _ZEROS.sub("&#", text))
    return html.unescape(text)


class _Frame:
    __slots__ = ("tag", "label", "shape", "first", "parts", "layout", "whole", "never", "chars", "linked", "links")

    def __init__(self, tag: str, label: str, shape: str, first: int, never: bool, inside: _Frame | None):
        self.tag, self.label, self.shape, self.first, self.whole, self.never = tag, label, shape, first, tag in WHOLE, never
        # what an inline element holds belongs to the block around it
        self.parts, self.layout = (inside.parts, inside.layout) if inside else ([], [])
        self.chars = self.linked = self.links = 0


class Page:
    """One pass over a page: ``blocks`` of the main text, ``hashes`` of its subtrees
    and layouts, and how many blocks went by ``template``, ``layout`` and ``rules``."""

    def __init__(self, source: str, template: set[int] | frozenset[int] = frozenset()):
        self.given = template
        self.all: list[str] = []
        self.hashes: set[int] = set()
        self.template = self.layout = self.rules = 0
        self.ranges: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.stack = [_Frame("", "", "", 0, False, None)]
        self.opened: defaultdict[str, list[int]] = defaultdict(list)
        self.pending: list[str] = []
        self.linked = 0
        self._read(source)
        for kind in ("article", "main"):
            if found := [self.all[a:b] for a, b in self.ranges[kind] if b > a]:
                self.blocks = [x for part in found for x in part]
                break
        else:
            self.blocks = self.all

    def _flush(self) -> None:
        if not self.pending:
            return
        text = _SPACE.sub(" ", unescape("".join(self.pending))).strip()
        self.pending.clear()
        linked, self.linked = self.linked, 0
        if text:
            self.all.append(text)
            frame = self.stack[-1]
            frame.parts.append(text)
            frame.chars += len(text)
            frame.linked += min(linked, len(text))
            if not frame.layout or frame.layout[-1] != "a" * (linked > 0) + "t":
                frame.layout.append("a" * (linked > 0) + "t")

    def _text(self, text: str) -> None:
        self.pending.append(text)
        if self.opened["a"] and not text.isspace():
            self.linked += len(text)

    def _delete(self, frame: _Frame) -> int:
        n = len(self.all) - frame.first
        del self.all[frame.first :]
        for found in self.ranges.values():
            while found and found[-1][0] >= frame.first:
                found.pop()
        return n

    def _close(self) -> None:
        frame = self.stack[-1]
        block = frame.tag in BLOCK
        if block or frame.never:
            self._flush()
        self.stack.pop()
        self.opened[frame.tag].pop()
        above = self.stack[-1]
        above.whole |= frame.whole
        above.chars += frame.chars
        above.linked += frame.linked
        above.links += frame.links + (frame.tag == "a")
        if block and frame.parts:
            h = xxhash.xxh64_intdigest("\x1f".join([frame.label, *frame.parts]))
            shape = xxhash.xxh64_intdigest("\x1f".join([frame.shape, *frame.layout]), _LAYOUT)
            above.parts.append(f"{h:x}")
            if not above.layout or above.layout[-1] != f"{shape:x}":
                above.layout.append(f"{shape:x}")
            if not frame.whole:
                h, shape = h - (1 << 63), shape - (1 << 63)
                self.hashes.add(h)
                menu = frame.links >= MIN_LINKS and 2 * frame.linked >= frame.chars
                if menu:
                    self.hashes.add(shape)
                if h in self.given:
                    self.template += self._delete(frame)
                elif menu and shape in self.given:
                    self.layout += self._delete(frame)
        if frame.never:
            self.rules += self._delete(frame)
        elif frame.tag in self.ranges and not self.opened[frame.tag]:
            self.ranges[frame.tag].append((frame.first, len(self.all)))

    def _down_to(self, i: int) -> None:
        while len(self.stack) > i:
            self._close()

    def _last(self, *tags: str) -> int:
        return max((self.opened[t][-1] for t in tags if self.opened[t]), default=0)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.pending.append(" ")
        elif not self.opened[tag]:
            if tag == "p":
                self._flush()
        else:
            i = self.opened[tag][-1]
            if tag in ("article", "main", "body", "html") or self._last("article", "main", "body") < i:
                self._down_to(i)

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
            if tag in _CLOSES:
                barrier = self._last(*_BARRIERS[tag])
                lowest = len(self.stack)
                for c in _CLOSES[tag]:
                    k = bisect_right(self.opened[c], barrier)
                    if k < len(self.opened[c]):
                        lowest = min(lowest, self.opened[c][k])
                self._down_to(lowest)
        if tag in VOID:
            self.pending.append(" " if tag == "br" else "")
            return
        out = never(tag, attrs, bool(self.opened["article"]))
        if out:
            self._flush()
            if attrs.endswith("/"):
                return
        self.opened[tag].append(len(self.stack))
        self.stack.append(_Frame(tag, *_label(tag, attrs), len(self.all), out, None if out or tag in BLOCK else self.stack[-1]))

    def _read(self, source: str) -> None:
        at = 0
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                at = _raw_end(source, tag, at)
            else:
                self._begin(tag, m[3])
        if at < len(source):
            self._text(source[at:])
        self._down_to(1)
        self._flush()


def page_blocks(source: str, template: set[int] | frozenset[int] = frozenset()) -> tuple[list[str], set[int]]:
    """(blocks of the main text, hashes of the block subtrees and layouts) of a page."""
    page = Page(source, template)
    return page.blocks, page.hashes


def _raw_end(source: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.IGNORECASE).search(source, at)
    end = source.find(">", m.end()) if m else -1
    return end + 1 if end >= 0 else len(source)


def host(url: Column) -> Column:
    """Host of a url in lower case, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, subtree) for each subtree, page naming the page's text, and
    one row without subtree for the page itself."""
    for b in small_batches(batches, "html", BATCH_BYTES):
        hosts, texts, hashes = [], [], []
        for h, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            blocks, found = page_blocks(source or "")
            hosts += [h] * (len(found) + 1)
            texts += [xxhash.xxh64_intdigest("\n".join(blocks)) - (1 << 63)] * (len(found) + 1)
            hashes += [*found, None]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(hashes, pa.int64())], names=["host", "page", "subtree"])


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): the hashes of each host's recurring subtrees.

    Pages of one text count once, so copies of an article do not make it a template."""
    hosted = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("host IS NOT NULL")
    seen = hosted.mapInArrow(_hash_batches, "host string, page long, subtree long").distinct()
    with Tables(pages.sparkSession, "subtrees") as tables:
        often = tables.put(seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages), "often")
        sizes = often.where("subtree IS NULL").select("host", F.col("n").alias("pages"))
        common = often.where("subtree IS NOT NULL").join(sizes, "host").where(F.col("n") >= min_share * F.col("pages"))
        return stored(common.groupBy("host").agg(F.collect_set("subtree").alias("template")), "templates")


_OUT = (("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64()), ("n_layout", pa.int64()), ("n_rules", pa.int64()))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "html", BATCH_BYTES):
        pages = [Page(s or "", frozenset(t or ())) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        rows = [(t, len(t), p.template, p.layout, p.rules) for p in pages for t in ["\n".join(p.blocks)]]
        found = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *found], names=[n for n, _ in _OUT])


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_template, n_layout, n_rules of every page."""
    templates = site_templates(pages, min_pages, min_share)
    given = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    joined = given.join(templates, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_text_batches, "page_id long, url string, text string, n_chars long, n_template long, n_layout long, n_rules long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(dealt_table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5_html_extract}
ORACLES: dict[str, str] = {}
