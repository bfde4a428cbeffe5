"""Main text of web pages, with the templates of each site removed.

One walk over the tags of a page gives its text in pieces, cut at block
elements, and the stretch of pieces that each element covers.  Three rules
remove elements, in this order:

* the site: every subtree with text is hashed (tags and text); Spark counts on
  how many pages of a host each hash comes, and subtrees that recur on many
  pages are deleted.  Copies of one article are one page in that count, told by
  the longest block, so that a mirrored text is no template.  Prose must be on
  at least half of the host's pages, and inside a marked article it is never
  deleted, since quoted passages recur.  A whole article that recurs is a
  teaser of the site, unless it is all that the page has marked;
* their kind: of what is left, menus, headers, footers, sidebars, forms,
  scripts, styles, and elements whose class, id or role says advert, notice,
  comment and the like.  An element around the article is never removed for its
  name;
* the article: a page that marks its article (articleBody, <article>, <main>)
  keeps what is left inside the mark.

Pages are counted by (host, hash), which splits a host with a third of all
rows.  Templates go to the pages as one small row a host; if they are too many
for that, each page's own are joined back by a fingerprint of the page.

Defined cases: null and empty html give an empty text; a null url is the host
''; a page cut off in the middle ends there; repeated rows are all returned and
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.joins import small_side
from sextant.scratch import materialize

#: Distinct pages of a host that must hold a subtree, and the share of the host's pages, for layout and for prose.
MIN_PAGES = 8
LAYOUT_SHARE = 0.1
PROSE_SHARE = 0.5
#: Words from which any subtree counts as prose.
PROSE_WORDS = 25
#: Share of a subtree's characters in links from which it is a menu, on pages without a marked article.
LINK_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements that hold no article text.
REMOVED = frozenset(
    "head script style title noscript template nav footer aside form button select textarea iframe object svg canvas audio "
    "video dialog menu noembed noframes xmp map".split()
)
#: Words of a class, id or role that name something beside the article.
CUES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social related "
    "recommended sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist "
    "reply replies respond disqus popup modal overlay widget toolbar pagination pager login search skip alert "
    "contentinfo complementary dialog form topbar disclaimer hidden".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre".split())
CONTENT_NAMES = frozenset(
    "content main-content maincontent article article-body articlebody article-content post post-body post-content entry "
    "entry-content story story-body page-content main".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
#: Start tags that end an open element of the first set, looked for above the nearest element of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Element:
    __slots__ = ("tag", "cue", "mark", "named", "begin", "end", "digest", "prose", "parent", "inner", "has_mark")

    def __init__(self, tag: str, begin: int, parent: int):
        self.tag, self.begin, self.end, self.parent = tag, begin, begin, parent
        self.cue = self.named = self.has_mark = self.prose = self.inner = False
        self.mark = 0
        self.digest = b""


def _described(element: _Element, rest: str) -> None:
    """What class, id, role and itemprop say about an element."""
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), (a or b or c).strip()
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            element.cue = True
        elif name == "itemprop":
            if value.lower() == "articlebody":
                element.mark = 3
        elif name in ("class", "id", "role"):
            if name == "role" and value.lower() in ("main", "article"):
                element.mark = max(element.mark, 1 if value.lower() == "main" else 2)
            if not CUES.isdisjoint(p.lower() for p in _NAME_PARTS.findall(value)):
                element.cue = True
            if not CONTENT_NAMES.isdisjoint(value.lower().split()):
                element.named = True
            if name == "role" and value.lower() == "banner" or "header" in value.lower().replace("-", " ").split():
                element.tag = "header" if element.tag in ("div", "section") else element.tag


class Page:
    """Text pieces of a page (None is a block boundary) and the elements over them."""

    def __init__(self, source: str, hashes: bool):
        self.pieces: list[str | None] = []
        self.elements: list[_Element] = []
        self._open: list[int] = []
        self._parts: list[list[bytes]] = []
        self._hashes = hashes
        self._read(source)
        while self._open:
            self._close()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            token = _TOKEN.search(source, at)
            self._text(source[at : token.start()] if token else source[at:])
            if token is None:
                return
            at = token.end()
            name = token["name"] or token["name2"]
            if name is None:
                continue
            name = name.lower()
            if token["end"] or token["end2"]:
                self._end(name)
                continue
            rest = token["rest"] or token["rest2"] or ""
            self._start(name, rest)
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else size
                self._close()
            elif name in VOID or (rest.endswith("/") and name in ("path", "use", "circle", "rect", "line")):
                self._close()

    def _text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self._hashes and self._parts:
                self._parts[-1].append(" ".join(text.split()).encode("utf-8", "replace"))

    def _start(self, name: str, rest: str) -> None:
        if name in ENDS_P:
            self._end_open({"p"}, {"td", "th", "table", "caption", "button", "object"})
        if name in ENDS:
            self._end_open(*ENDS[name])
        if name not in INLINE:
            self.pieces.append(" " if name in ("br", "wbr", "img", "input") else None)
        element = _Element(name, len(self.pieces), self._open[-1] if self._open else -1)
        if name == "article":
            element.mark = 2
        elif name == "main":
            element.mark = 1
        if rest:
            _described(element, rest)
        self._open.append(len(self.elements))
        self.elements.append(element)
        self._parts.append([])

    def _end_open(self, closes: set, barrier: set) -> None:
        """Closes the highest open element that a start tag ends, unless a barrier comes first."""
        for depth in range(len(self._open) - 1, -1, -1):
            tag = self.elements[self._open[depth]].tag
            if tag in closes:
                while len(self._open) > depth:
                    self._close()
                if closes == {"p"} or depth == 0 or self.elements[self._open[-1]].tag not in closes:
                    return
            elif tag in barrier:
                return

    def _end(self, name: str) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            element = self.elements[self._open[depth]]
            if element.tag == name or (element.tag == "header" and name in ("div", "section")):
                while len(self._open) > depth:
                    self._close()
                return
            if name in INLINE and element.tag not in INLINE:
                return
            if name in ("p", "li") and element.tag in ("td", "table", "article", "body", "ul", "ol"):
                return

    def _close(self) -> None:
        element = self.elements[self._open.pop()]
        parts = self._parts.pop()
        element.end = len(self.pieces)
        if element.tag not in INLINE and element.tag not in VOID:
            self.pieces.append(None)
        if not self._open:
            return
        parent = self.elements[self._open[-1]]
        parent.has_mark |= element.has_mark or element.mark > 0
        parent.prose |= element.prose or element.tag in PROSE
        parent.inner |= element.inner or element.tag not in INLINE and element.tag not in VOID
        if self._hashes:
            packed = b"\x01".join(parts)
            element.digest = hashlib.blake2b(element.tag.encode() + b"\x00" + packed, digest_size=8).digest()
            self._parts[-1].append(element.digest)

    def blocks(self, kept: bytearray) -> list[str]:
        """Blocks of the pieces that are kept, white space folded."""
        out, run = [], []
        for k, piece in enumerate(self.pieces):
            if piece is None:
                if run:
                    out.append(" ".join("".join(run).split()))
                    run = []
            elif kept[k]:
                run.append(piece)
        out.append(" ".join("".join(run).split()))
        return [b for b in out if b]


def _spread(ranges: list[tuple[int, int]], size: int) -> bytearray:
    flags = bytearray(size)
    for begin, end in ranges:
        flags[begin:end] = b"\x01" * (end - begin)
    return flags


def _subtrees(page: Page) -> list[tuple[int, bool | None, int | None]]:
    """Hash of each subtree, whether it is prose (None: of an article, never deleted), and its size if it is one block."""
    out, marked_until = set(), 0
    words, chars = [0], [0]
    for p in page.pieces:
        parts = p.split() if p else ()
        words.append(words[-1] + len(parts))
        chars.append(chars[-1] + sum(map(len, parts)))
    for e in page.elements:
        inside = e.begin < marked_until
        if e.mark or e.named and not e.has_mark:
            marked_until = max(marked_until, e.end)
        n = words[e.end] - words[e.begin]
        if not n or not e.digest or e.tag in ("head", "html", "body", "main") or e.tag in INLINE or e.has_mark:
            continue
        prose = e.prose or e.tag in PROSE
        size = None if e.inner else chars[e.end] - chars[e.begin]
        if not (prose and inside):
            out.add((_signed(e.digest), bool(prose or e.mark or n >= PROSE_WORDS), size))
        elif size:
            out.add((_signed(e.digest), None, size))
    return list(out)


def _signed(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


class Judged:
    """A page without the templates of its site, judged by the rules that look at it alone."""

    def __init__(self, source: str | None, templates: frozenset = frozenset()):
        self.page = page = Page(source or "", bool(templates))
        size = len(page.pieces)
        removed = self._recurring(templates) if templates else []
        until = 0
        inside_mark_until = 0
        for e in page.elements:
            if e.begin < until:
                continue
            if e.mark and e.begin >= inside_mark_until:
                inside_mark_until = e.end
            by_name = e.cue and e.tag not in ("html", "body", "main")
            header = e.tag == "header"
            if (by_name or header or e.tag in REMOVED) and not e.has_mark:
                if header and not by_name and e.begin < inside_mark_until:
                    removed += self._all_but_headings(e)
                else:
                    removed.append((e.begin, e.end))
                until = e.end
        gone = _spread(removed, size)
        self.left = bytearray(1 - g for g in gone)
        self.marked = self._article()
        if self.marked is None:
            self._drop_menus()

    def _recurring(self, templates: frozenset) -> list[tuple[int, int]]:
        """Stretches of the elements that are templates; articles only beside one that is none."""
        found, until, inside = [], 0, 0
        marks = [e for e in self.page.elements if e.mark and not e.has_mark]
        own = any(not (e.digest and _signed(e.digest) in templates) for e in marks)
        for e in self.page.elements:
            if e.begin < until:
                continue
            within = e.begin < inside
            if e.mark or e.named and not e.has_mark:
                inside = max(inside, e.end)
            prose = e.prose or e.tag in PROSE
            if not e.digest or e.has_mark or _signed(e.digest) not in templates or within and prose or e.mark and not own:
                continue
            found.append((e.begin, e.end))
            until = e.end
        return found

    def _all_but_headings(self, header: _Element) -> list[tuple[int, int]]:
        out, at = [], header.begin
        for e in self.page.elements:
            if e.tag in HEADINGS and header.begin <= e.begin and e.end <= header.end and e.begin >= at:
                out.append((at, e.begin))
                at = e.end
        return [*out, (at, header.end)]

    def _chars(self, begin: int, end: int) -> int:
        return sum(len(p.strip()) for k, p in enumerate(self.page.pieces[begin:end], begin) if p and self.left[k])

    def _article(self) -> list[tuple[int, int]] | None:
        """Stretches of the strongest mark that holds text; articles made of links are teasers of others."""
        for level in (3, 2, 1, 0):
            found, until = [], 0
            for e in self.page.elements:
                fits = e.mark == level if level else e.named
                if fits and e.begin >= until and self._chars(e.begin, e.end):
                    found.append(e)
                    until = e.end
            if level == 2 and len(found) > 1:
                full = [e for e in found if self._linked(e) < LINK_SHARE * self._chars(e.begin, e.end)]
                found = full or found
            if found:
                return [(e.begin, e.end) for e in found]
        return None

    def _linked(self, element: _Element) -> int:
        total, until = 0, 0
        for e in self.page.elements:
            if e.tag == "a" and element.begin <= e.begin < element.end and e.begin >= until:
                total, until = total + self._chars(e.begin, e.end), e.end
        return total

    def _drop_menus(self) -> None:
        pieces = self.page.pieces
        chars, linked = [0], [0]
        links = _spread([(e.begin, e.end) for e in self.page.elements if e.tag == "a"], len(pieces))
        for k, p in enumerate(pieces):
            n = len(p.strip()) if p and self.left[k] else 0
            chars.append(chars[-1] + n)
            linked.append(linked[-1] + (n if links[k] else 0))
        for e in self.page.elements:
            if e.tag in ("ul", "ol", "div", "table", "section", "dl"):
                n = chars[e.end] - chars[e.begin]
                if n and linked[e.end] - linked[e.begin] >= LINK_SHARE * n:
                    self.left[e.begin : e.end] = bytes(e.end - e.begin)

    def blocks(self) -> list[str]:
        kept = self.left
        if self.marked is not None:
            inside = _spread(self.marked, len(kept))
            kept = bytearray(a & b for a, b in zip(kept, inside))
        return self.page.blocks(kept)


def _host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", -1)).otherwise("")
    return F.lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def _find_subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for host, a, b, source in zip(batch["host"], batch["a"], batch["b"], batch["html"]):
            found = _subtrees(Page(source or "", True))
            out += [(host, a, b, *s) for s in found or [(None, None, None)]]
        # As objects first: numbers beside a missing value would become floating.
        frame = pd.DataFrame(out, columns=["host", "a", "b", "subtree", "prose", "size"], dtype=object)
        yield frame.astype({"a": "int64", "b": "int64", "subtree": "Int64", "prose": "boolean", "size": "Int64"})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for source, templates in zip(batch["html"], batch["templates"]):
            gone = frozenset() if templates is None else frozenset(int(t) for t in templates)
            texts.append("\n\n".join(Judged(source, gone).blocks()))
        yield pd.DataFrame(
            {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}
        )


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with host and a 128-bit fingerprint; equal rows share it."""
    key = [F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))]
    return pages.select(
        "page_id", "url", "html", _host(F.col("url")).alias("host"),
        F.xxhash64(*key).alias("a"), F.xxhash64(F.lit(1), *reversed(key)).alias("b"),
    )


def templates(found: DataFrame) -> DataFrame:
    """(host, subtree) that recur on enough pages of the host.

    ``found`` is stored: a row per page and subtree, or one row without a subtree.
    """
    trees = found.where("subtree is not null")
    # Rows that a repeated page adds can only make a candidate more; pages are counted once each below.
    counts = trees.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    often = small_side(materialize(counts.where(F.col("n") >= MIN_PAGES), "frequent"))
    rare = trees.where("size is not null").join(often, ["host", "subtree"], "left_anti")
    told = rare.groupBy("host", "a", "b").agg(F.max(F.struct("size", "subtree"))["subtree"].alias("page"))
    told = materialize(told, "told-apart")

    def distinct(rows: DataFrame, *keys: str) -> DataFrame:
        """How many different pages there are; those without a rare block are one, unless they have no subtree."""
        alone = F.when(F.col("subtree").isNull(), F.col("a")).otherwise(F.lit(0))
        each = rows.join(told, ["host", "a", "b"], "left").withColumn("page", F.coalesce("page", alone))
        return each.groupBy(*keys).agg(F.count_distinct("page").alias("pages"), F.max("prose").alias("prose"))

    of = distinct(found, "host").select("host", F.col("pages").alias("of"))
    share = F.when(F.col("prose"), F.lit(PROSE_SHARE)).otherwise(F.lit(LAYOUT_SHARE))
    recurring = distinct(trees.where("prose is not null").join(often, ["host", "subtree"], "left_semi"), "host", "subtree")
    recurring = recurring.where(F.col("pages") >= MIN_PAGES).join(of, "host")
    return recurring.where(F.col("pages") >= share * F.col("of")).select("host", "subtree")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; blocks are joined by an empty line."""
    keyed = _keyed(pages)
    found = materialize(
        keyed.select("host", "a", "b", "html").mapInPandas(
            _find_subtrees, "host string, a long, b long, subtree long, prose boolean, size long"
        ),
        "subtrees",
    )
    often = materialize(templates(found), "templates")
    by_host = materialize(often.groupBy("host").agg(F.collect_set("subtree").alias("templates")), "host-templates")
    side = small_side(by_host)
    if side is not by_host:
        joined = keyed.join(side, "host", "left")
    else:
        gone = found.where("subtree is not null").join(small_side(often), ["host", "subtree"]).groupBy("a", "b")
        gone = materialize(gone.agg(F.collect_set("subtree").alias("templates")), "page-templates")
        joined = keyed.join(small_side(gone), ["a", "b"], "left")
    return joined.select("page_id", "url", "html", "templates").mapInPandas(
        _extract, "page_id long, url string, text string, n_chars long"
    )
