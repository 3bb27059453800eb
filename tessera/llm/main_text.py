"""Operator 12: the main text of web pages, by two-pass block rules.

A page is read once into blocks: runs of text between block-level tags, with
character references decoded and white space folded. Blocks of elements that
are page furniture by their tag, role, class or id (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) are set aside. What stays is
judged in two passes over all blocks of a batch of pages:

1. Link density, length and stop-word density decide a block: mostly links is
   not main text, a long run with enough stop words is, a long run without any
   is not. The rest is undecided.
2. An undecided block takes the label of its nearest decided neighbours. Within
   an ``article`` the element itself is a neighbour that says yes, so only a
   short block without stop words between two blocks of links goes.

If a page has an ``article`` with text (else a ``main``), blocks outside it are
not main text. A page without either is judged by its blocks alone.

An element that is set aside counts only if its end tag is there (else up to the
next block), and one known by class or id alone not if the page's first article
lies in it, so a forgotten end tag or a layout class does not lose the article.

Null html reads as empty; a page without main text gets an empty text. Rows are
independent: repeated pages repeat their result, no order or extra column
matters. A page's own blocks are the most a task holds beyond its batch.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table
from .common import strings, text_slices

#: Characters from which a block is long enough to be decided by its words, and
#: from which it is decided against if it has too few stop words.
SHORT, LONG = 70, 200
#: Share of stop words that prose has, share below which a long block is none,
#: and share of characters in links above which a block is a list of links.
STOP_HIGH, STOP_LOW, MOST_LINKS = 0.15, 0.02, 0.5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
a about all also an and are as at be been but by can for from had has have he her his i if in is it its more no not of
on one or our she so than that the their there they this to up was we were what when which who will with would you
aber als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im
ist mit nach nicht noch nur oder sich sie sind und um von vor war wie wir zu zum zur
au aux avec ce cette dans de du elle en est et il je la le les leur lui mais ne nous on ou par pas plus pour qu que qui
sa se ses son sont sur un une vous
al como con del el era esta este fue ha hay la las lo los más me mi muy o para pero por que se si sin su sus también y ya
""".split())
# Elements that end a run of text, that hold no text of the page, whose content is no markup, that
# are set aside, and words of roles, classes and ids that say so.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
SKIPPED = frozenset("audio button canvas head iframe noscript object select svg template video".split())
ASIDE_TAGS = frozenset("nav footer aside form dialog menu header".split())
ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense alert alertdialog banner
breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer
gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager
pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar
sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/][^>]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BODY = re.compile(r"\b(?:article|post|entry|story|main)[-_]?(?:body|content|text)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: What an end tag may close without its own: items and cells up to their list or table.
_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
           "th": ("tr", "table"), "option": ("select",)}


def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I)


_ENDS = {tag: _end_of(tag) for tag in (*RAW, *SKIPPED, "span", "ins")}


def _role(tag: str, attributes: str) -> tuple[str | None, bool]:
    """What an element is by tag, role, class and id: ``aside``, ``article``,
    ``main`` or nothing; and whether its tag or role says so."""
    words, role = set(), ""
    if "=" in attributes and tag not in ("html", "body"):
        for name, *value in _ATTRIBUTE.findall(attributes):
            value = "".join(value)
            if name.lower() == "role":
                role = value.strip().lower()
            if name.lower() == "itemprop":
                words.update({"articleBody"} & set(value.split()))
            elif _BODY.search(value):
                words.add("articleBody")
            else:
                words.update(re.split(r"[^a-z0-9]+", value.lower()))
    if tag in ASIDE_TAGS or role in ASIDE_WORDS or role == "form":
        return "aside", True
    if words & ASIDE_WORDS and "articleBody" not in words:
        return "aside", False
    if tag == "article" or role == "article":
        return "article", True
    if tag == "main" or role == "main" or "articleBody" in words:
        return "main", True
    return None, False


class Page:
    """The blocks of one page: text, characters in links, whether a heading, and
    the numbers of the marked elements around it."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.marked: list[list] = []  # kind, by tag or role, tag, closed, marked elements around, first block
        self._open: list[tuple[str, int]] = []  # tags and their numbers in marked, -1 for others
        self._run: list[str] = []
        self._links = self._linked = 0
        self._read(html)
        self._flush()

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                around = tuple(k for _, k in self._open if k >= 0)
                heading = any(tag in HEADINGS for tag, _ in self._open[-4:])
                self.blocks.append((text, self._linked, heading, around))
            self._run, self._linked = [], 0

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _TOKEN.match(html, at)
            at = m.end()
            tag = m[2]
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    text = references.unescape(text)
                    self._run.append(text)
                    if self._links:
                        self._linked += len("".join(text.split()))
                continue
            tag = tag.lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW or tag in SKIPPED or (tag in ("span", "ins") and _role(tag, m[3])[0] == "aside"):
                end = _ENDS[tag].search(html, at)
                at = end.end() if end else size if tag in RAW else at
            else:
                self._start(tag, m[3])

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close_open(tag)
        elif tag == "br":
            self._run.append(" ")
        if tag in VOID:
            return
        kind, sure = _role(tag, attributes)
        if kind:
            self._flush()
            around = tuple(k for _, k in self._open if k >= 0)
            self.marked.append([kind, sure, tag, False, around, len(self.blocks)])
        self._open.append((tag, len(self.marked) - 1 if kind else -1))
        self._links += tag == "a"

    def _close_open(self, tag: str) -> None:
        """A block ends an open paragraph; an item or cell ends the one before it."""
        for k in range(len(self._open) - 1, -1, -1):
            other = self._open[k][0]
            if other == "p" or (other == tag and tag in _CLOSES):
                self._cut(k)
                return
            if other in _CLOSES.get(tag, ()) or (tag not in _CLOSES and other in BLOCKS):
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                number = self._open[k][1]
                if number >= 0:
                    self._flush()
                    self.marked[number][3] = True
                self._cut(k)
                return

    def _cut(self, k: int) -> None:
        self._links -= sum(tag == "a" for tag, _ in self._open[k:])
        del self._open[k:]

    def candidates(self) -> tuple[list[int], bool]:
        """The blocks that are not set aside, and whether they lie in an article or
        main element."""
        first = next((n for n, m in enumerate(self.marked) if m[0] == "article"), None)
        if first is None:
            first = next((n for n, m in enumerate(self.marked) if m[0] == "main"), None)
        holders = set(self.marked[first][4]) if first is not None else set()

        def aside(n: int, block: int, around: tuple[int, ...]) -> bool:
            kind, sure, tag, closed, own, start = self.marked[n]
            if kind != "aside" or (n in holders and not (sure and closed and tag != "header")):
                return False
            if tag == "header" and any(self.marked[k][0] != "aside" and self.marked[k][5] == start for k in own):
                return False  # the title of an article, at its begin
            return closed or block == start

        inside = [[n for n in around if not aside(n, k, around)] if not any(aside(n, k, around) for n in around) else None
                  for k, (_, _, _, around) in enumerate(self.blocks)]
        for wanted in ("article", "main"):
            found = [k for k, around in enumerate(inside)
                     if around is not None and any(self.marked[n][0] == wanted for n in around)]
            if found:
                return found, True
        return [k for k, around in enumerate(inside) if around is not None], False


def judged(length: np.ndarray, stop: np.ndarray, links: np.ndarray, heading: np.ndarray, page: np.ndarray,
           scoped: np.ndarray) -> np.ndarray:
    """Which blocks are main text; ``page`` is ascending, the other arrays hold the
    length, the shares of stop words and of linked characters, whether a block is
    a heading and whether it lies in an article."""
    linked = (links > MOST_LINKS) & ~heading
    label = np.zeros(len(page), np.int8)  # 1 main text, -1 not, 0 undecided
    label[(length >= SHORT) & (stop >= STOP_HIGH)] = 1
    prose = np.bincount(page, label > 0) > 0  # a block that is no prose is told by one that is
    label[(length >= LONG) & (stop < STOP_LOW) & ~scoped & prose[page]] = -1
    label[linked] = -1
    place = np.arange(len(page))
    if not len(place):
        return label > 0
    begin = np.searchsorted(page, page)
    end = np.searchsorted(page, page, "right") - 1
    decided = np.where(label != 0, place, -1)
    before = np.maximum.accumulate(decided)
    after = np.minimum.accumulate(np.where(label != 0, place, len(place))[::-1])[::-1]
    has_before, has_after = before >= begin, after <= end
    left = np.where(has_before, label[before.clip(0)], 0)
    right = np.where(has_after, label[after.clip(max=len(place) - 1)], 0)
    nearer = np.where(has_before & has_after, np.sign((after - place) - (place - before)), np.sign(has_before * 1 - has_after * 1))
    given = np.where(nearer > 0, left, np.where(nearer < 0, right, np.where(left == right, left, 0)))
    own = np.where(stop > 0, 1, np.where(has_before | has_after, -1, 1))  # neighbours disagree, or there are none
    given = np.where(given != 0, given, own)
    between = (left < 0) & (right < 0) & (before == place - 1) & (after == place + 1) & (length < SHORT) & (stop == 0)
    given = np.where(scoped, np.where(between, -1, 1), given)
    return np.where(label != 0, label, given) > 0


def main_texts(pages: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Main text, number of blocks and of kept blocks of each page."""
    read = [Page(html) for html in pages]
    page, rows, scoped = [], [], []
    for n, p in enumerate(read):
        chosen, inside = p.candidates()
        page += [n] * len(chosen)
        rows += [p.blocks[k] for k in chosen]
        scoped += [inside] * len(chosen)
    words = [_WORD.findall(text.lower()) for text, *_ in rows]
    length = np.array([len(text) for text, *_ in rows], np.int64)
    stop = np.array([sum(w in STOP_WORDS for w in ws) / max(1, len(ws)) for ws in words])
    solid = np.array([len(text) - text.count(" ") for text, *_ in rows], np.int64)
    links = np.array([linked for _, linked, _, _ in rows]) / np.maximum(solid, 1)
    heading = np.array([h for _, _, h, _ in rows], bool)
    keep = judged(length, stop, links, heading, np.array(page, np.int64), np.array(scoped, bool))
    texts: list[list[str]] = [[] for _ in pages]
    for n, (text, *_), kept in zip(page, rows, keep, strict=True):
        if kept:
            texts[n].append(text)
    return ["\n\n".join(t) for t in texts], [len(p.blocks) for p in read], [len(t) for t in texts]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """``keep`` columns with text, n_chars (code points), n_blocks and n_kept."""
    fields = [pages.schema[c] for c in keep]
    schema = T.StructType(fields + [T.StructField("text", T.StringType()), *(
        T.StructField(c, T.LongType()) for c in ("n_chars", "n_blocks", "n_kept"))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, "__html"):
            texts, blocks, kept = main_texts(strings(rows, "__html"))
            columns = [rows.column(k) for k in range(len(keep))]
            columns += [pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in (list(map(len, texts)), blocks, kept))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pages.select(*keep, pages[column].alias("__html")).mapInArrow(run, schema)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, n_blocks, n_kept."""
    ensure_checkpoint_dir(spark)
    return extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
