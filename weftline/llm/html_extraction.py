"""HTML extraction by consensus host paths.

First pass: in every page the containers (body, article, div, ...) are scored by the text they hold outside links and
boilerplate, half of it passing on to each outer container. A page's containers vote, in shares of the page's best score,
for their generalised paths: the tags from the root with their classes, digits made equal. Spark adds the votes of each
host. Of the paths that hold ``ENOUGH`` of a page's text, the one with most votes of its host wins the page (rows of pages and paths are
joined with the votes, so no path of a host is left out). Second pass: a page's text is taken from the containers on that path (or, if
no path holds enough, on the page's own best one), in page order, and from what they are parts
of: the innermost article or main around each whole; any outer container whole that adds ``OWN`` of the text in its own blocks
or ``BESIDE`` of it anywhere; and of other outer containers below body the blocks of their own. Links don't count as text here.

Left out wherever they stand: menus, footers, scripts, styles and hidden elements; and page headers, sidebars, notices, adverts,
forms, comments of readers, by their tag or by a class, id or role that says so as a whole or with its last word. The latter drop
nothing that holds the page's only article or main with text, or most of the text of a page without one: a page in one form
keeps its text. The header of an article is part of it.

Defined results: null or empty html gives an empty text; html without any tag is one block; a null or malformed url is the
host ''; rows that repeat a page are extracted one by one (and vote one by one); equal votes go to the longer, then
the smaller path; other columns are ignored. Unclosed tags end with what holds them. Attribute values may have any length;
a quote opens one only after "=", and one that no later quote closes is an ordinary character.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import attached, bounded_batches, own_columns, staged, table

ENOUGH = 0.4
OWN, BESIDE = 0.05, 1 / 3  # text outside links that an outer container adds, itself and in all, to be taken whole
PAGE = ("page_key", "page_key2")
PATHS = "page_key long, page_key2 int, host string, path string, share long, enough boolean"

# Fixed values of HTML: elements that hold others, that are never main text, that hold no markup, that break a block.
CONTAINERS = frozenset("html body div section article main table blockquote figure details center td".split())
NOISE = frozenset("head nav footer menu button select label noscript svg math audio video canvas object".split())
SOFT = frozenset("header aside form fieldset dialog".split())  # as a name: boilerplate, unless the main text is inside
LISTS = frozenset("ul ol dl".split())  # their names hold for all items
HOLDERS = CONTAINERS | NOISE | SOFT | LISTS
RAW = frozenset("script style textarea template iframe noframes xmp title".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr th thead tbody tfoot caption pre hr br figcaption address summary option legend".split()) | CONTAINERS | NOISE | SOFT
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus menubar breadcrumb breadcrumbs toc pagination pager header masthead topbar footer bottombar colophon"
    " sidebar sidebars aside rail widget widgets related recommended recommendations trending popular"
    " notice notices cookie cookies consent gdpr alert alerts disclaimer copyright popup modal overlay toast"
    " comment comments commentlist disqus replies reply respond reactions"
    " share sharing social follow newsletter subscribe subscription signup login form search searchbox skip".split()
)
# Words that may stand beside such a name in one class ("sidebar-left", "site-header"); any other makes it another name ("no-sidebar").
PLACES = frozenset("left right top bottom upper lower primary secondary main site page global local list box bar wrap wrapper container area section block inner outer item items link links slot unit group thread text body title".split())

# Names that say so as the last word of any other ("user-comments", "article-ad"), unless a word before them says the contrary.
LAST_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo comment comments replies disqus newsletter subscribe signup cookie cookies consent sidebar breadcrumb breadcrumbs nav navbar menu pagination share sharing".split())
CONTRARY = frozenset("no not non has have with without is hide".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# one attribute with what stands before it; a quote that is never closed is part of a bare value
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/><][^\s/>=<]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s><]*+)))?+)?+")
NAME_PART = re.compile(r"[a-z]+")


def _is_noise(name: str) -> bool:
    """Whether a class, id or role names boilerplate, as a whole (digits and words for places in it don't matter) or by its last word."""
    parts = NAME_PART.findall(name)
    if parts and parts[-1] in LAST_WORDS and CONTRARY.isdisjoint(parts):
        return True
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in PLACES for p in parts)


def _attributes(text: str) -> tuple[str, bool, bool]:
    """Classes for the generalised path, whether a name says that this isn't main text, and whether it is hidden."""
    own: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        own.setdefault(name.lower(), html.unescape(a or b or c).lower())  # the first of a name counts
    classes = sorted({re.sub(r"\d+", "0", x) for x in own.get("class", "").split()})
    named = any(_is_noise(x) for name in ("class", "id", "role") for x in own.get(name, "").split())
    hidden = "hidden" in own or own.get("aria-hidden", "").strip() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")) is not None
    return "." + ".".join(classes) if classes else "", named, hidden


def _tag_end(source: str, at: int, open_ends: set[int]) -> int:
    """Where the tag whose name ends at ``at`` ends, -1 if it doesn't. open_ends: places from which no tag ends."""
    passed = []
    while at not in open_ends:
        passed.append(at)
        at = ATTRIBUTE.match(source, at).end()
        if source.startswith(">", at):
            return at + 1
        if at == passed[-1]:
            break
    open_ends.update(passed)
    return -1


class Page:
    """blocks: (container, text, characters in links) of all main-text candidates in page order; containers: a path and
    the outer container's number for each."""

    def __init__(self, source: str):
        self.containers: list[tuple[str, int]] = [("", -1)]
        self.tags: list[str] = [""]
        self.blocks: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]
        names: list[tuple[int, int]] = []  # by element whose name is boilerplate: the next one around it, and its container
        under: list[int] = []  # by block: the innermost such element
        parts: list[str] = []
        linked, in_link, block_noise, block_name, at, look = 0, False, False, -1, 0, 0
        open_ends: set[int] = set()

        def flush() -> None:
            nonlocal linked, block_noise, block_name
            if parts:
                text = " ".join("".join(parts).split())
                if text and not block_noise:
                    self.blocks.append((stack[-1][1], text, linked))
                    under.append(block_name if block_name >= 0 else stack[-1][3])
                parts.clear()
            linked, block_noise, block_name = 0, False, -1

        def take(text: str) -> None:
            nonlocal linked
            if text and not stack[-1][2]:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                linked += len(text) if in_link else 0

        while m := TOKEN.search(source, look):
            end = _tag_end(source, m.end(), open_ends) if m[2] else m.end()
            if end < 0:
                look = m.start() + 1
                continue
            take(source[at : m.start()])
            at = look = end
            if not m[2]:
                continue
            inside = source[m.end() : end - 1]
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = look = close.end() if close else len(source)
                continue
            if tag == "a":
                in_link = not closing
            if tag in BREAKS:
                if tag == "br":
                    parts.append(" ")
                    continue
                flush()
            elif closing:
                continue
            if closing:
                if tag in HOLDERS:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                continue
            if tag in VOID:
                continue
            classes, named, noise = _attributes(inside) if inside.strip() else ("", False, False)
            _, outer, outer_noise, name = stack[-1]
            if tag in SOFT:  # the header of an article holds its heading
                named |= tag != "header" or not self._in_article(outer)
            # a page's own frame may carry any class; it is never the boilerplate itself
            if named and tag not in ("html", "body", "main", "article"):
                names.append((name, outer))
                name = len(names) - 1
            if tag in HOLDERS:
                if inside.endswith("/"):
                    continue
                noise = outer_noise or tag in NOISE or noise and tag not in ("html", "body", "main", "article")
                here = outer
                if not noise and tag in CONTAINERS:
                    here = len(self.containers)
                    self.containers.append((f"{self.containers[outer][0]}>{tag}{classes}", outer))
                    self.tags.append(tag)
                stack.append((tag, here, noise, name))
            elif tag in BREAKS:
                block_noise, block_name = noise, name
        take(source[at:])
        flush()
        self._drop_named(names, under)

    def _in_article(self, c: int) -> bool:
        """Whether a container is an article or main, or in one."""
        while c >= 0 and self.tags[c] not in ("article", "main"):
            c = self.containers[c][1]
        return c >= 0

    def _articles(self) -> list[int]:
        """By container: the innermost article or main around it, or -1."""
        found = [-1] * len(self.containers)
        for c, tag in enumerate(self.tags):
            found[c] = c if tag in ("article", "main") else found[self.containers[c][1]] if c else -1
        return found

    def _drop_named(self, names: list[tuple[int, int]], under: list[int]) -> None:
        """Drop the blocks in elements whose name is boilerplate. Where no article or main has text outside them, those that
        hold one with text, or most of the page's text outside links, are main text in spite of their names."""
        if not names:
            return
        prose = [max(0, len(text) - 2 * linked) for _, text, linked in self.blocks]
        article = self._articles()
        held, has = [0] * len(names), [False] * len(names)
        main_outside = False
        for (c, _, _), n, k in zip(self.blocks, prose, under, strict=True):
            if k < 0:
                main_outside |= n > 0 and article[c] >= 0
            else:
                held[k] += n
                has[k] |= n > 0 and article[c] > names[k][1]
        for k in range(len(names) - 1, -1, -1):
            around = names[k][0]
            if around >= 0:
                held[around] += held[k]
                has[around] |= has[k]
        most, dropped = sum(prose) / 2, [False] * len(names)
        for k, (around, _) in enumerate(names):
            dropped[k] = around >= 0 and dropped[around] or main_outside or not (has[k] or held[k] > most)
        self.blocks = [x for x, k in zip(self.blocks, under, strict=True) if k < 0 or not dropped[k]]

    def scores(self) -> list[float]:
        """By container: its own text outside links, and half of each inner container's score."""
        score = [0.0] * len(self.containers)
        for c, text, linked in self.blocks:
            score[c] += max(0, len(text) - 2 * linked) + 1
        for c in range(len(score) - 1, 0, -1):
            score[self.containers[c][1]] += score[c] / 2
        return score

    def votes(self) -> dict[str, float]:
        """Shares of the best path's score, by path."""
        by: Counter[str] = Counter()
        for (path, _), s in zip(self.containers, self.scores(), strict=True):
            by[path] += s
        best = max(by.values(), default=0)
        return {p: s / best for p, s in by.items() if s > 0} if best else {}

    def inside(self, roots: set[int]) -> list[bool]:
        """By container: whether it is one of roots or in one."""
        found = [False] * len(self.containers)
        for c, (_, outer) in enumerate(self.containers):
            found[c] = c in roots or outer >= 0 and found[outer]
        return found

    def whole(self, roots: set[int]) -> list[str]:
        """The texts of the roots and of what they are parts of."""
        outer, article = [o for _, o in self.containers], self._articles()
        wholes, around, parts_of = roots | {article[c] for c in roots} - {-1}, set(), set()
        for c in roots:
            while (c := outer[c]) >= 0 and c not in around:
                around.add(c)
        found = self.inside(wholes)
        every, kept, own = [0] * len(outer), [0] * len(outer), [0] * len(outer)
        for c, text, linked in self.blocks:
            own[c] += max(0, len(text) - 2 * linked)
        for c in range(len(outer) - 1, -1, -1):  # inner before outer
            every[c] += own[c]
            beside = every[c] - kept[c]
            if found[c]:
                kept[c] = every[c]
            elif c in around and beside and (own[c] and own[c] >= OWN * kept[c] or beside >= BESIDE * kept[c]):
                kept[c] = every[c]
                wholes.add(c)
            elif c in around and self.tags[c] not in ("", "html", "body"):
                parts_of.add(c)
                kept[c] += own[c]
            if c:
                every[outer[c]] += every[c]
                kept[outer[c]] += kept[c]
        found = self.inside(wholes)
        return [text for c, text, linked in self.blocks if found[c] or c in parts_of and len(text) > 2 * linked]

    def enough(self) -> set[str]:
        """The paths whose containers hold ENOUGH of the page's text. No container is in another of its own path."""
        every = [0] * len(self.containers)
        for c, text, _ in self.blocks:
            every[c] += len(text)
        everything, by = sum(every), Counter[str]()
        for c in range(len(every) - 1, -1, -1):  # inner before outer
            by[self.containers[c][0]] += every[c]
            if c:
                every[self.containers[c][1]] += every[c]
        return {p for p, n in by.items() if n >= ENOUGH * everything} if everything else set()

    def text(self, winner: str | None) -> str:
        """The main text by the winning path, or by the page's own best one."""
        by: dict[str, set[int]] = {}
        for c, (path, _) in enumerate(self.containers):
            by.setdefault(path, set()).add(c)
        votes = self.votes()
        if winner not in by:
            winner = max(votes, key=lambda p: (votes[p], len(p), p)) if votes else None
        return " ".join(self.whole(by[winner])) if winner is not None and self.blocks else ""


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def with_key(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the columns PAGE, which equal rows share."""
    own = own_columns(pages, "page_id", "url", "html")
    return own.withColumns({"page_key": F.xxhash64("page_id", "url", "html"), "page_key2": F.hash("html", "url", "page_id")})


def page_paths(pages: DataFrame) -> DataFrame:
    """A row for each page and path with a share of votes: the share in thousandths, and whether the path holds enough text."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, key2, host, source in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                page = Page(source or "")
                enough = page.enough()
                rows += [(key, key2, host, path, round(share * 1000), path in enough) for path, share in page.votes().items()]  # whole numbers add up alike in any order
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PATHS.split(", ")])

    return with_key(pages).select(*PAGE, host_of(F.col("url")).alias("host"), "html").mapInArrow(run, PATHS)


def winning_paths(paths: DataFrame) -> DataFrame:
    """PAGE and path: of the page's paths with enough text the one with most votes of its host. Equal votes go to the longer, then the
    smaller path. Votes are added up in each task before they are shuffled."""
    named = paths.withColumns({"host_key": F.xxhash64("host"), "path_key": F.xxhash64("path")})
    votes = named.groupBy("host_key", "path_key").agg(F.sum("share").alias("votes"))
    voted = attached(named.where("enough").select(*PAGE, "host_key", "path_key", "path"), votes, ["host_key", "path_key"], "inner", "votes")
    best = F.min_by("path", F.struct(-F.col("votes"), -F.length("path"), F.col("path")))
    return voted.groupBy(*PAGE).agg(best.alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = winning_paths(staged(page_paths(pages), "paths"))
    joined = with_key(pages).join(winners, list(PAGE), "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(source or "").text(path) for source, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
