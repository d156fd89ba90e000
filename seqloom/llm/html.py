"""Main text of web pages by removing each site's template.

Every element of a page is a range of its token stream, so the hash of a subtree (tags, class, id and text) is a
difference of rolling prefix hashes. Spark counts on how many different pages of a host each subtree of the main region
(the outermost article, else main, else the body) occurs; those on at least MIN_PAGES, however many pages the host has,
recur. A page of whose region COPY or more recurs, in characters and in lines, is a copy of another and no evidence:
what recurs there is the article's own. A subtree is the site's template, and deleted on all pages of the host, if it recurs on MIN_PAGES pages
that differ in the rest; paragraphs, lists, tables and figures of an article must besides stand at the same place
(counted in blocks from the start or from the end) on half of these pages, as a quoted passage does not. However long or
short they are, quotations and preformatted text never are template, and headings go only together with the block that
follows them. What is on fewer than MIN_PAGES pages of a host stays.
What the markup itself declares not to be the article (navigation, forms, asides, adverts, comments, scripts, ...) is
deleted too: its text may differ from page to page. A class or id declares it only as a whole name, on a container that
holds neither the article nor most of the page's text.

Character references are decoded, white space in a block becomes one space, blocks are joined by a newline. Null and
empty pages give the empty text. Pages without host are counted together. Rows with one page_id are taken one by one;
equal pages count once. Unclosed tags, comments and quotes end where a browser would end them or with the page.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import bounded, small_batches, staged

MIN_PAGES = 4
COPY = 0.75
COPY_OF_ARTICLE = 0.5

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul caption".split()
)
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of an article's text blocks those that may be template: whole ones, and headings together with what follows.
WHOLE_BLOCKS = HEADINGS | frozenset("p ul ol dl table figure".split())
QUOTES = frozenset("blockquote pre".split())
NOT_TEXT = frozenset(
    "head script style noscript template nav footer aside form iframe object embed svg canvas audio video map button"
    " select option input textarea label fieldset menu dialog title search noframes noembed applet".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
CHROME_WORDS = frozenset(
    "ad ads adv adsense adbox adslot nav navigation masthead pager pagination cookie cookies consent gdpr alert notice notices"
    " notification notifications popup modal overlay newsletter signup login share sharing social related recommended"
    " recommendations trending disqus reply replies respond respondform widget widgets toolbar topbar skip skiplink tags tagcloud".split()
)
CHROME_STARTS = (
    "advert", "banner", "breadcrumb", "comment", "footer", "menu", "navbar", "promo", "sidebar", "sponsor", "subscri", "usercomment",
)
HEADER_STARTS = ("header", "siteheader", "pageheader")
SITE_WORDS = frozenset("site page global top main fixed sticky wrap wrapper container inner outer".split())
#: Words that may stand beside a telling one without changing what the name says (share-buttons, but not share-price).
PART_WORDS = SITE_WORDS | frozenset(
    "area bar block body bottom box btn button buttons content form group icon icons item items left line link links list module"
    " panel post posts primary right row secondary section slot strip text title unit zone".split()
)
DISCUSSION = ("comment", "usercomment", "disqus", "reply", "replies", "respond")
PROSE = ("commentary", "commentator")
CONTAINERS = frozenset("div section aside header footer ul ol dl table details center ins".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "dd", "dt", "li", "figcaption"}
#: A start tag ends an open element of the first kind unless one of the second kind stands between.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
SCOPES = frozenset("table td th caption button object article section main div body html".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
#: A tag of which a quote or the end is missing ends at the next ">".
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
#: So many tags of a page are searched to its end for the missing quote; in later ones quotes hide no ">".
MAX_BROKEN = 64
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_000_037


@dataclass
class Part:
    """An element that may be template: the characters and lines that are in it and in no smaller part, its place in blocks
    from the start and the end of the region, whether it is a text block of an article, and the region's characters and
    lines."""

    element: int
    hash: int
    size: int
    lines: int
    before: int
    after: int
    held: bool
    total: int
    total_lines: int
    article: bool


class Page:
    """The token stream of a page and its elements.

    tokens: ("<", element), (">", element) or ("t", text). Elements are numbered in page order; for each its tag,
    attributes, parent (-1: none) and the range of its tokens.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        self.tag: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self._open: list[int] = []
        # Where in it there are elements of each tag, blocks, and elements that </p> does not reach out of.
        self._at: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._scopes: list[int] = []
        self._read(source)
        self._mark()

    def _places(self, tag: str) -> list[list[int]]:
        out = [self._at.setdefault(tag, [])]
        if tag in BLOCKS:
            out.append(self._blocks)
            if tag in SCOPES:
                out.append(self._scopes)
        return out

    def _last(self, *tags: str) -> int:
        """The depth of the innermost open element of these tags; -1 if there is none."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=-1)

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            e = self._open.pop()
            for places in self._places(self.tag[e]):
                places.pop()
            self.tokens.append((">", e))
            self.end[e] = len(self.tokens)

    def _close_within(self, kinds, stops) -> None:
        depth = self._last(*kinds)
        if depth < 0 or self._last(*(t for t in stops if t not in kinds)) > depth:
            return
        while depth > 0 and self.tag[self._open[depth - 1]] in kinds:
            depth -= 1
        self._close_to(depth)

    def _begin(self, tag: str, raw: str) -> None:
        if tag in IMPLIED_END:
            self._close_within(*IMPLIED_END[tag])
        if tag in CLOSES_P:
            self._close_within(("p",), SCOPES)
        e = len(self.tag)
        attrs = {}
        if raw.strip():
            for m in _ATTRIBUTE.finditer(raw):
                attrs.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self._open[-1] if self._open else -1)
        self.start.append(len(self.tokens))
        self.end.append(len(self.tokens) + 1)
        self.tokens.append(("<", e))
        if tag not in VOID:
            for places in self._places(tag):
                places.append(len(self._open))
            self._open.append(e)

    def _finish(self, tag: str) -> None:
        depth = self._last(tag)
        # The end tag of an inline element does not reach out of its block, nor does </p> out of its container.
        around = self._blocks if tag not in BLOCKS else self._scopes if tag == "p" else []
        if depth >= 0 and not (around and around[-1] > depth):
            self._close_to(depth)

    def _read(self, source: str) -> None:
        at, size, broken = 0, len(source), 0
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self.tokens.append(("t", source[at:]))
                break
            m = _TOKEN.match(source, lt) if broken < MAX_BROKEN or source.startswith(("<!", "<?"), lt) else None
            if not m and (m := _BROKEN.match(source, lt)):
                broken += 1
            if not m:
                nxt = source.find("<", lt + 1)
                nxt = size if nxt < 0 else nxt
                self.tokens.append(("t", source[at:nxt]))
                at = nxt
                continue
            if lt > at:
                self.tokens.append(("t", source[at:lt]))
            at = m.end()
            if not m[2]:
                continue
            closing, tag, raw = m[1], m[2], m[3]
            tag = tag.lower()
            if closing:
                self._finish(tag)
                continue
            self._begin(tag, raw)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                stop = stop.start() if stop else size
                if tag in ("title", "textarea") and stop > at:
                    self.tokens.append(("t", source[at:stop]))
                at = stop
        self._close_to(0)

    def _mark(self) -> None:
        """Which elements are declared not to be text (`out`, of themselves or through an ancestor), and the main region."""
        plain, inside = [], []  # out by tag, role or style; within an article or main
        for e, tag in enumerate(self.tag):
            p = self.parent[e]
            within = p >= 0 and (inside[p] or self.tag[p] in ("article", "main"))
            inside.append(within)
            plain.append((p >= 0 and plain[p]) or tag in NOT_TEXT or (tag == "header" and not within) or self._hidden(e))
        upto, skip = [0], 0
        for at, (kind, value) in enumerate(self.tokens):
            if kind == "<" and plain[value]:
                skip = max(skip, self.end[value])
            upto.append(upto[-1] + (len("".join(value.split())) if kind == "t" and at >= skip else 0))
        size = [upto[b] - upto[a] for a, b in zip(self.start, self.end, strict=True)]
        visible = [0]
        for kind, value in self.tokens:
            visible.append(visible[-1] + (kind == "t" and not value.isspace()))
        named = [not plain[e] and self._chrome(e, inside[e]) for e in range(len(self.tag))]
        below = []
        for e, n in enumerate(named):
            below.append(n or (self.parent[e] >= 0 and below[self.parent[e]]))
        # What holds the article (where there is one that no telling name is around, that) or most of the text stays.
        cores = [e for e, t in enumerate(self.tag) if (t in ("article", "main") or self.attrs[e].get("role") == "main") and size[e] and not plain[e]]
        held = set()
        if cores and all(below[e] for e in cores):
            e = max(cores, key=lambda e: (size[e], -e))
            while e >= 0:
                held.add(e)
                e = self.parent[e]
        self.out = []
        for e, n in enumerate(named):
            if n and self.tag[e] != "article":
                talk = any(w.startswith(DISCUSSION) for w in self._names(self.attrs[e]))
                n = e not in held and not (size[e] == upto[-1] if talk else 2 * size[e] > upto[-1])
            self.out.append((self.parent[e] >= 0 and self.out[self.parent[e]]) or plain[e] or n)
        shown = [e for e in range(len(self.tag)) if not self.out[e]]
        region: list[int] = []
        for kind in ("article", "main", "body"):
            region = [e for e in shown if (self.tag[e] == kind or (kind == "main" and self.attrs[e].get("role") == "main"))]
            region = [e for e in region if visible[self.end[e]] > visible[self.start[e]]]
            if region:
                break
        # The outermost of them only.
        self.region, upto = [], -1
        for e in region:
            if self.start[e] >= upto:
                self.region.append((self.start[e], self.end[e]))
                upto = self.end[e]
        self.has_article = bool(region) and self.tag[region[0]] == "article"
        if not region:
            self.region = [(0, len(self.tokens))]

    def _hidden(self, e: int) -> bool:
        a = self.attrs[e]
        if not a:
            return False
        if a.get("role", "").lower() in CHROME_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
            return True
        return "style" in a and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I))

    def _chrome(self, e: int, within: bool) -> bool:
        """Whether a class or the id of a container says, as a whole, that it is not text."""
        a = self.attrs[e]
        if not a:
            return False
        if self.tag[e] == "article":
            return any(w.startswith("comment") and w not in PROSE for w in self._names(a))
        if self.tag[e] not in CONTAINERS:
            return False
        for name in f"{a.get('class', '')} {a.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(name)]
            telling = [w for w in words if w in CHROME_WORDS or (w.startswith(CHROME_STARTS) and w not in PROSE)]
            rest = [w for w in words if w not in telling and not w.isdigit()]
            if telling and all(w in PART_WORDS or w.startswith(HEADER_STARTS) for w in rest):
                return True
            if not within and any(w.startswith(HEADER_STARTS) for w in words) and all(w in SITE_WORDS or w.startswith(HEADER_STARTS) for w in rest):
                return True
        return False

    @staticmethod
    def _names(a: dict[str, str]) -> list[str]:
        return [w.lower() for w in _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")]

    def subtrees(self) -> list[Part]:
        """The elements of the main region that may be template."""
        prefix, text_upto, power, blocks, lines, begun = [0], [0], [1], [0], [0], False
        for kind, value in self.tokens:
            new = False
            if kind == "t":
                words = " ".join(value.split())
                seen = words
                new, begun = bool(words) and not begun, begun or bool(words)
            else:
                begun = begun and self.tag[value] not in BLOCKS
                a = self.attrs[value]
                words, seen = "", f"{kind}{self.tag[value]} {a.get('class', '')} {a.get('id', '')}"
            h = int.from_bytes(hashlib.blake2b(seen.encode("utf-8", "replace"), digest_size=7).digest()) + 1
            prefix.append((prefix[-1] * _BASE + h) % _PRIME)
            text_upto.append(text_upto[-1] + len(words))
            power.append(power[-1] * _BASE % _PRIME)
            lines.append(lines[-1] + new)
            blocks.append(blocks[-1] + (kind == "<" and self.tag[value] in BLOCKS and not self.out[value]))
        total = sum(text_upto[b] - text_upto[a] for a, b in self.region)
        total_lines = sum(lines[b] - lines[a] for a, b in self.region)
        starts = [a for a, _ in self.region]
        out, taken, quoted = [], {}, []
        for e, tag in enumerate(self.tag):
            p = self.parent[e]
            quoted.append(tag in QUOTES or (p >= 0 and quoted[p]))
            taken[e] = taken.get(p, -1)  # the nearest part around
            a, b = self.start[e], self.end[e]
            text = text_upto[b] - text_upto[a]
            at = bisect.bisect_right(starts, a) - 1
            if at < 0 or b > self.region[at][1] or (a, b) == self.region[at] or not text:
                continue
            if tag in ("html", "head", "title", "meta") or tag not in BLOCKS or self.out[e] or quoted[e]:
                continue
            held = self.has_article and tag in TEXT_BLOCKS
            if held and tag not in WHOLE_BLOCKS:
                continue
            x, y = self.region[at]
            hash_ = (prefix[b] - prefix[a] * power[b - a]) % _PRIME
            part = Part(e, hash_, text, lines[b] - lines[a], blocks[a] - blocks[x], blocks[y] - blocks[b], held, total, total_lines, self.has_article)
            if taken[e] >= 0:
                out[taken[e]].size -= text
                out[taken[e]].lines -= part.lines
            taken[e] = len(out)
            out.append(part)
        return out

    def _deleted(self, template) -> set[int]:
        gone = {x.element for x in self.subtrees() if x.hash in template}
        following: dict[int, int] = {}
        for e in range(len(self.tag) - 1, -1, -1):
            after = following.get(self.parent[e])
            if e in gone and self.has_article and self.tag[e] in HEADINGS and after not in gone:
                gone.discard(e)
            following[self.parent[e]] = e
        return gone

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks of the main region, without what is template or declared not to be text."""
        gone = self._deleted(template) if template else ()
        blocks, parts = [], []

        def flush():
            words = " ".join(entities.unescape("".join(parts)).split())
            if words:
                blocks.append(words)
            parts.clear()

        for begin, end in self.region:
            at = begin
            while at < end:
                kind, value = self.tokens[at]
                if kind == "t":
                    parts.append(value)
                else:
                    tag = self.tag[value]
                    if tag in BLOCKS:
                        flush()
                    elif tag == "br":
                        parts.append(" ")
                    if kind == "<" and (self.out[value] or value in gone):
                        at = self.end[value]
                        continue
                at += 1
            flush()
        return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_PARTS = "host string, page long, subtree long, share float, lines float, before int, after int, held boolean, article boolean"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("subtree", pa.int64()), ("share", pa.float32()), ("lines", pa.float32()), ("before", pa.int32()), ("after", pa.int32()), ("held", pa.bool_()), ("article", pa.bool_())])
    for batch in batches:
        rows = []
        for host, page, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first: dict[int, list] = {}
            for x in Page(source or "").subtrees():
                share, lines = x.size / x.total, x.lines / max(x.total_lines, 1)
                if x.hash in first:
                    first[x.hash][3] += share
                    first[x.hash][4] += lines
                else:
                    first[x.hash] = [host, page, x.hash, share, lines, x.before, x.after, x.held, x.article]
            rows += first.values()
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _top_place(parts: DataFrame, place: str) -> DataFrame:
    """Per subtree of a host: on how many pages it is, and on how many of them at its commonest place."""
    at = parts.groupBy("host", "subtree", place).agg(F.count("*").alias("n"), F.min("held").alias("held"))
    return at.groupBy("host", "subtree").agg(F.sum("n").alias("n"), F.max("n").alias(f"top_{place}"), F.min("held").alias("held"))


def templates(pages: DataFrame) -> DataFrame:
    """(page, subtrees): for each page with template on it, by the hash of host and source, the subtrees to delete."""
    found = staged(pages.select("host", "page", "html").mapInArrow(_found, _PARTS).dropDuplicates(["page", "subtree"]), "subtrees")
    often = found.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "subtree")
    recurring = staged(found.join(bounded(staged(often, "often")), ["host", "subtree"]), "recurring")
    copy = F.least("recurs", "lines") >= F.when(F.col("article"), COPY_OF_ARTICLE).otherwise(COPY)
    sums = [F.sum("share").alias("recurs"), F.sum("lines").alias("lines"), F.first("article").alias("article")]
    copies = recurring.groupBy("page").agg(*sums).where(copy)
    evidence = staged(recurring.join(copies.select("page"), "page", "left_anti"), "evidence")
    counts = _top_place(evidence, "before").join(_top_place(evidence, "after").select("host", "subtree", "top_after"), ["host", "subtree"])
    top = F.greatest("top_before", "top_after")
    fixed = ~F.col("held") | ((top >= MIN_PAGES) & (2 * top >= F.col("n")))
    template = bounded(staged(counts.where((F.col("n") >= MIN_PAGES) & fixed).select("host", "subtree"), "template"))
    return staged(recurring.join(template, ["host", "subtree"]).groupBy("page").agg(F.collect_list("subtree").alias("subtrees")), "deleted")


def _texts(source: pa.Array, subtrees: pa.Array) -> pa.Array:
    return pa.array([Page(s or "").text(set(t or ())) for s, t in zip(source.to_pylist(), subtrees.to_pylist(), strict=True)], pa.string())


def extracted(pages: DataFrame, out: str = "text") -> DataFrame:
    """`pages` (page_id, url, html) with the main text of each."""
    small_batches(pages.sparkSession)
    page = F.xxhash64(host_of(F.col("url")), F.coalesce(F.col("html"), F.lit("")))
    keyed = pages.select(host_of(F.col("url")).alias("host"), page.alias("page"), "html")
    deleted = bounded(templates(keyed)).withColumnRenamed("page", "_page").withColumnRenamed("subtrees", "_subtrees")
    rows = pages.withColumn("_page", page).join(deleted, "_page", "left")
    return rows.withColumn(out, F.arrow_udf(_texts, "string")("html", "_subtrees")).drop("_page", "_subtrees")


def text_report(pages: DataFrame) -> DataFrame:
    rows = extracted(pages.select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
