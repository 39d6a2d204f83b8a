"""Page text by consensus host paths.

1. Every page is cut into blocks of text, each with the path of containers it is
   in. A container is named by tag and class words with digits masked, so that the
   pages of one template share paths. Each page's paths are scored by the text
   their containers hold less what is in links, and the best one's path is the page's vote.
2. Votes are counted per host in Spark (pre-aggregated) and each host's leading
   path wins.
3. Every page is cut again and its text taken from the containers on the winning
   path; a page without such a container keeps its own best one.

Blocks inside menus, headers, footers, sidebars, forms, notices, adverts, comments
and the like (``SKIP_TAGS``, ``SKIP_WORDS``) are no text. A word in a class or id does
not count after has, with, no and the like (``TELLS``), nor on main, nor as the last
word on an article; and a container that such a word would skip stays if it holds
most of the page's unlinked text (see ``blocks``). Character references
are decoded; white space inside a block becomes one space; blocks are joined by
one space in page order.

Results for odd input: null and empty pages have empty text; markup that is cut
off or not closed is read as far as it goes; pages without a host share the empty
host; repeated rows are extracted each on its own and vote each; an empty table
gives an empty result; the result has the id, the url and its own columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, with_python

# How tags are treated, and the words in classes and ids that mark what is no main text.
DROP_TAGS = (
    "script style noscript template textarea title iframe svg math object canvas select button video audio"
).split()
SKIP_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTAINERS = frozenset("html body main article section div td table ul ol blockquote center details".split())
BLOCKS = CONTAINERS | SKIP_TAGS | frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd pre br hr tr th thead tbody tfoot caption address summary figure figcaption".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
ROOTS = frozenset("html body".split())
#: An open item outside of the innermost of these is none of the list being read.
HOLDS_ITEMS = (CONTAINERS - {"div"}) | frozenset(["menu"])
MAIN = frozenset("article main".split())
SKIP_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget ad ads advert adverts advertisement"
    " banner sponsor sponsored promo notice notices cookie cookies consent gdpr alert popup modal newsletter subscribe signup login share sharing social"
    " comment comments reply replies disqus related recommended pagination pager skip copyright legal toolbar".split()
)
#: What readers add may outweigh the main text.
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
#: Words after which a class tells what a page or part has, not what it is.
TELLS = frozenset("has have with without no non".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A path is a candidate if it holds this share of a page's unlinked text; less is asked of article and main.
SHARE, MAIN_SHARE = 0.7, 0.2
#: A container skipped by a word stays if it holds more than this share of the unlinked text outside comments.
MOST = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""",
    re.S,
)
_DROP_END = {t: re.compile(rf"</{t}\s*+(?:>|\Z)", re.I) for t in DROP_TAGS}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

Block = tuple[tuple[str, ...], str, int]


def _skip_words(tag: str, value: str) -> set[str]:
    """The words of a class or id that mark an element as no main text."""
    found = set()
    for c in value.split():
        w = [x.lower() for x in _WORD.findall(c)]
        if w and tag not in ROOTS and tag != "main":
            # A class such as "site-header" or "nav_main" is judged by its first and last word.
            last = w[-1:] if tag != "article" and TELLS.isdisjoint(w[:-1]) else []
            found |= SKIP_WORDS.intersection(w[:1] + last)
    return found


def _marks(tag: str, attrs: str, in_main: bool) -> tuple[bool, set[str], str]:
    """Whether an element is never main text, the words that tell so by class or id, and its name in a path."""
    skip, words, classes = tag in SKIP_TAGS and not (tag == "header" and in_main), set(), ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            classes = value
        if name in ("class", "id"):
            words |= _skip_words(tag, value)
        elif name == "role":
            skip = skip or value.lower() in SKIP_ROLES
        else:
            skip = skip or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower())
    # The classes of html and body tell pages apart, not parts of a page.
    return skip, words, tag if tag in ROOTS else ".".join([tag, *sorted({re.sub(r"\d+", "0", c.lower()) for c in classes.split()})])


class _Cutter:
    """One pass over a page's marks: the open elements and the block being read."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, bool, int]] = []  # tag, name in the path, skipped, doubtful container (its number or 0)
        self.skipping = self.linked = self.in_link = 0
        self.piece: list[str] = []
        self.out: list[Block] = []
        self.within: list[tuple[int, ...]] = []  # of each block: the doubtful containers that it is in
        self.by_comment = [False]  # of each doubtful container: whether a word for comments skips it

    def words(self, text: str) -> None:
        if text and not self.skipping:
            self.piece.append(text)
            self.linked += len(text) if self.in_link else 0

    def end_block(self) -> None:
        text = _SPACE.sub(" ", unescape("".join(self.piece))).strip() if self.piece else ""
        if text:
            self.out.append((("#", *(name for tag, name, _, _ in self.open if tag in CONTAINERS)), text, min(self.linked, len(text))))
            self.within.append(tuple(d for *_, d in self.open if d))
        self.piece, self.linked = [], 0

    def push(self, tag: str, name: str, skip: bool, doubtful: int = 0) -> None:
        self.open.append((tag, name, skip, doubtful))
        self.skipping += skip

    def pop(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all inside it; none open, nothing happens."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.skipping -= sum(s for _, _, s, _ in self.open[k:])
                del self.open[k:]
                return
            if tag == "li" and self.open[k][0] in HOLDS_ITEMS:
                return

    def mark(self, tag: str, attrs: str, closing: bool) -> None:
        if tag == "a":
            self.in_link = 0 if closing else 1
        if tag in BLOCKS:
            self.end_block()
            self.in_link = 0
            if self.open and self.open[-1][0] == "p" and tag not in ("br", "hr"):
                self.pop("p")  # a paragraph ends where a block begins
            if tag == "li" and not closing:
                self.pop("li")  # an item ends at the next one of its list
        if closing:
            if tag in CONTAINERS or tag in SKIP_TAGS or self.skipping:
                self.pop(tag)
        elif tag not in VOID and not attrs.endswith("/"):
            skip, words, name = _marks(tag, attrs, any(o[0] in MAIN for o in self.open)) if attrs or tag in SKIP_TAGS else (False, (), tag)
            doubtful = 0
            if words and tag in CONTAINERS and not skip and not self.skipping:
                doubtful = len(self.by_comment)
                self.by_comment.append(not COMMENT_WORDS.isdisjoint(words))
            elif words:
                skip = True
            # Other elements matter only where they are skipped or inside what is.
            if tag in CONTAINERS or tag in SKIP_TAGS or skip or (self.skipping and (tag not in BLOCKS or tag == "li")):
                self.push(tag, name, skip, doubtful)

    def kept(self) -> list[Block]:
        """The blocks outside the doubtful containers, and inside those that hold most of the page."""
        if len(self.by_comment) == 1:
            return self.out
        plain = [len(text) - linked for _, text, linked in self.out]
        held = [0] * len(self.by_comment)
        for size, within in zip(plain, self.within, strict=True):
            for d in within:
                held[d] += size
        whole = sum(plain)
        comments = sum(size for size, within in zip(plain, self.within, strict=True) if any(self.by_comment[d] for d in within))
        # Comments stay only if what is outside would be too little for a main text, other containers if it is the smaller part.
        stay = [held[d] > (1 - MAIN_SHARE) * whole if by else held[d] > MOST * (whole - comments) for d, by in enumerate(self.by_comment)]
        return [block for block, within in zip(self.out, self.within, strict=True) if all(stay[d] for d in within)]


def blocks(html: str) -> list[Block]:
    """The kept blocks of a page in order: container path (from ``#``, the page), text, characters in links.

    A container that a word in its class or id would skip is doubtful until the page
    is read: it stays if it holds more than ``MOST`` of the unlinked text outside
    comments, one for comments if it leaves less than ``MAIN_SHARE`` of all.
    """
    cut, at, end = _Cutter(), 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            cut.words(html[at:])
            break
        cut.words(html[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag not in _DROP_END:
                cut.mark(tag, m[3], bool(m[1]))
            elif not m[1]:
                stop = _DROP_END[tag].search(html, at)
                at = stop.end() if stop else end
    cut.end_block()
    return cut.kept()


def vote(cut: list[Block]) -> str | None:
    """The path of a page's best containers.

    A path is scored by the unlinked text of all its containers. Of the paths that
    hold enough of the page's, article and main go first, then the deepest, then
    the one with the least linked text; ties go to the first path in order.
    """
    held: dict[tuple[str, ...], list[int]] = {}
    for path, text, linked in cut:
        for k in range(1, len(path) + 1):
            got = held.setdefault(path[:k], [0, 0])
            got[0] += len(text) - linked
            got[1] += linked
    whole = max((plain for plain, _ in held.values()), default=0)
    best = None
    for path, (plain, linked) in held.items():
        main = path[-1].partition(".")[0] in MAIN
        if plain and plain >= (MAIN_SHARE if main else SHARE) * whole:
            rank = (not main, -len(path), linked, path)
            best = min(best, rank) if best else rank
    return ">".join(best[-1]) if best else None


def taken(cut: list[Block], path: str | None) -> str | None:
    """The text of the containers on a path; null if the page has none."""
    want = tuple(path.split(">")) if path else ()
    found = [text for p, text, _ in cut if want and p[: len(want)] == want]
    return " ".join(found) if found else None


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = [vote(blocks(h)) if h else None for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string())], names=["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
            cut = blocks(html) if html else []
            got = taken(cut, path)
            texts.append((taken(cut, vote(cut)) or "") if got is None else got)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])


def host_of(url: Column) -> Column:
    """The host of an address in small letters, without port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``path`` and ``votes`` of each host's winning path; ties go to the first path in order."""
    with_python(pages.sparkSession)
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_vote, "host string, path string")
    counted = votes.where(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count("*").alias("votes"))
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path")).alias("b"))
    return best.select("host", F.col("b.path").alias("path"), (-F.col("b.less")).alias("votes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = 100_000) -> DataFrame:
    """``id``, ``url`` and ``text`` of every page row.

    The winning paths are broadcast if they were counted to be at most ``small``;
    else Spark joins them by host with a shuffle, splitting hosts of many pages.
    """
    winners = durable(host_paths(pages, url_col, html_col).select("host", "path"))
    paths = F.broadcast(winners) if winners.count() <= small else winners
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    joined = rows.join(paths, "host", "left").select("id", "url", "html", "path")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string")
