"""Main text of web pages by tag-path ratios.

Every block of text of a page has a path of tags from the root; the paths form a
trie.  Per path the text length, the number of blocks, the punctuation and the
linked text are added up.  The ratios text per block, punctuation per block and
unlinked share are fused into one value; values are smoothed over neighbouring
paths of the same part of the page, weighted by text and by tree distance; names
and elements weigh in; paths that reach a share of the best value are content.

Parts and weights: a navigation, advert, form or comment element lowers the
value of its paths by a factor, once for each such element, and never to zero.
Once an article element holds text, what lies outside it counts little.  An
article or main element starts afresh: within a form or a wrapper whose name
sounds like a sidebar it is the article when no article lies outside such an
element.  One within boilerplate of another article (a reader's comment) is not.
Of names, ``has-``, ``with-`` and ``no-`` describe the neighbourhood, and common
words such as ``share`` count less beside other words.  In an article, lists of
links are text.

The whole page is read, character references are decoded, white space inside a
block becomes one space, and the chosen blocks are joined by one space in page
order.  Broken markup is read as browsers do: unclosed elements end with their
parent, a new block ends an open paragraph.

Nulls: a null page is an empty page and has an empty text; a null id is carried
along.  Repeated rows and other columns are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegov.llm.common import text_batches

# Share of the best smoothed value that a content path reaches.
THRESHOLD = 0.15
INSIDE, OUTSIDE = 3.0, 0.25
# Factor of a boilerplate element, and the number of them that are counted.
DOWN, MOST_DOWN = 0.02, 3.0
# Weight of a neighbouring path, per step between the two in the tree.
_STEP = math.exp(-1)

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 head header html legend li main menu nav ol option p pre search "
             "section select summary table tbody td tfoot th thead title tr ul button textarea label".split())
_NO_TEXT = set("head script style noscript template iframe object svg canvas math audio video".split())
_BOILERPLATE = set("nav footer aside form menu dialog button select textarea input label fieldset search".split())
_NAMES = set("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
             "aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer cookie cookies "
             "consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
             "login search share sharing social related recommended recommendations comment comments disqus replies "
             "respond widget toolbar pagination pager copyright disclaimer hidden".split())
# Names that are also plain words, and words that say nothing beside them.
_COMMON = set("share sharing header related search notice alert social menu promotion replies label hidden".split())
_NEUTRAL = set("site page top global block section container wrapper inner outer bar box list item items link links button "
               "buttons icon icons area left right nav main".split())
_ABOUT_OTHERS = re.compile(r"(has|with|without|no)[-_]")
_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_CONTAINERS = {"article", "main"}
# An element of the first kind ends an open element of the second kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_MARKS = re.compile(r"[.,;:!?…。、，！？]")
_WORD = re.compile(r"[a-z]+")


def named_down(names: str) -> float:
    """How far class and id names lower an element: 0 not at all, 1 as much as a navigation element."""
    words = {w for token in names.split() if not _ABOUT_OTHERS.match(token) for w in _WORD.findall(token)}
    named = words & _NAMES
    if not named:
        return 0.0
    if named - _COMMON:
        return 1.0
    return (len(named) / len(words - _NEUTRAL | named)) ** 2


class Path:
    """A path of block elements with what its blocks add up to.  Its part of the
    page (``kind``) is "plain", "inside" an article, or "again" inside one that
    boilerplate surrounds; ``down`` counts the boilerplate elements around it."""

    __slots__ = ("parent", "kind", "down", "children", "text", "blocks", "marks", "linked")

    def __init__(self, parent, kind, down):
        self.parent, self.kind, self.down, self.children = parent, kind, down, {}
        self.text = self.blocks = self.marks = self.linked = 0

    def child(self, label, kind, down):
        key = (label, kind, down)
        if key not in self.children:
            self.children[key] = Path(self, kind, down)
        return self.children[key]


class PageReader(HTMLParser):
    """Collects the blocks of one page: (path, text) in page order.  An open
    element is (tag, path before it, whether text is read in it)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.path = Path(None, "plain", 0.0)
        self.open: list[tuple[str, Path, bool]] = []
        self.open_blocks: list[int] = []  # places of block elements in ``open``
        self.counts: Counter = Counter()  # open elements by tag
        self.reads = True
        self.blocks: list[tuple[Path, str]] = []
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = self.path
                path.text += len(text)
                path.blocks += 1
                path.marks += len(_MARKS.findall(text))
                path.linked += min(self.linked, len(text))
                self.blocks.append((path, text))
            self.parts = []
        self.linked = 0

    def pop_to(self, depth: int) -> None:
        if self.open_blocks and self.open_blocks[-1] >= depth:
            self.flush()
        while len(self.open) > depth:
            tag, self.path, self.reads = self.open.pop()
            self.counts[tag] -= 1
            if self.open_blocks and self.open_blocks[-1] == len(self.open):
                self.open_blocks.pop()

    def part(self, tag: str, names: dict[str, str]) -> tuple[str, float]:
        """Kind and count of boilerplate of a block element in the current path."""
        kind, down = self.path.kind, self.path.down
        if tag in ("html", "body"):
            return kind, down  # the root elements describe the page, not a part of it
        own = named_down(names.get("class", "") + " " + names.get("id", ""))
        if tag in _BOILERPLATE or names.get("role") in _ROLES or (tag == "header" and kind == "plain"):
            own = 1.0
        if tag in _CONTAINERS or names.get("role") == "main":
            if kind == "plain" and own < 1:
                return ("inside", 0.0) if down < 1 else ("again", 0.0)
            if tag == "main":
                own = 0.0
        return kind, min(down + own, MOST_DOWN)

    def handle_starttag(self, tag, attrs):
        if tag == "br" or tag == "hr" or tag == "wbr":
            self.parts.append(" " if tag != "wbr" else "")
        if tag in _VOID:
            return
        if tag in _BLOCK:
            self.flush()
            ends = _ENDS.get(tag, ())
            while self.open_blocks and ((other := self.open[self.open_blocks[-1]][0]) == "p" or other in ends):
                self.pop_to(self.open_blocks[-1])
        names = {k: (v or "").lower() for k, v in attrs}
        before = self.path, self.reads
        if tag in _NO_TEXT or "hidden" in names or "display:none" in names.get("style", "").replace(" ", ""):
            self.reads = False
        if tag in _BLOCK:
            words = sorted(set(_WORD.findall(names.get("class", "") + " " + names.get("id", ""))))
            self.path = self.path.child(".".join([tag, *words]), *self.part(tag, names))
            self.open_blocks.append(len(self.open))
        self.counts[tag] += 1
        self.open.append((tag, *before))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.counts[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.pop_to(at)
        elif tag == "br":
            self.parts.append(" ")

    def handle_data(self, data):
        if self.reads:
            self.parts.append(data)
            if self.counts["a"]:
                self.linked += len(data)


def read_page(html: str) -> PageReader:
    at = html.rfind("<")
    if at >= 0 and re.match(r"[a-zA-Z/!?][^>]*$", html[at + 1:]):
        html = html[:at]  # the page ends within a tag
    reader = PageReader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader


def ratio(path: Path) -> float:
    """The fused ratios of a path with text."""
    links = path.linked / path.text * (1.0 if path.kind == "plain" else 0.5)
    return math.log1p(path.text / path.blocks) * (1 + math.log1p(path.marks / path.blocks)) * (1 - links)


def weight(path: Path, best_kind: str) -> float:
    """``best_kind`` is where the article is: "inside", else "again", else "plain"."""
    return (1.0 if best_kind == "plain" else INSIDE if path.kind == best_kind else OUTSIDE) * DOWN ** path.down


def content_paths(root: Path, threshold: float = THRESHOLD) -> set:
    """The paths whose smoothed and weighted ratios make them content.

    A path's smoothed value is the mean of the values of all paths that it
    reaches without leaving its part of the page, weighted by their text and by
    ``exp(-steps)``.  Sums go up the trie and down again, so it is linear."""
    order = [root]
    for path in order:
        order.extend(path.children.values())
    own = {p: ratio(p) if p.text else 0.0 for p in order}
    # Text and text times value: of a path and those below it, then of all.
    below = {p: [p.text if own[p] > 0 else 0.0, p.text * own[p]] for p in order}

    def tied(p: Path) -> bool:
        return p.parent is not None and (p.kind, p.down) == (p.parent.kind, p.parent.down)

    for p in reversed(order):
        if tied(p):
            for i in range(2):
                below[p.parent][i] += _STEP * below[p][i]
    everything = {}
    for p in order:
        everything[p] = below[p]
        if tied(p):
            # What the parent sees, without its share from here, one step further off.
            everything[p] = [b + _STEP * max(e - _STEP * b, 0.0) for b, e in zip(below[p], everything[p.parent])]
    with_text = [p for p in order if own[p] > 0]
    kinds = {p.kind for p in with_text}
    best_kind = next(k for k in ("inside", "again", "plain") if k in kinds or k == "plain")
    values = {p: weight(p, best_kind) * everything[p][1] / everything[p][0] for p in with_text}
    best = max(values.values(), default=0.0)
    return {p for p, value in values.items() if value >= threshold * best}


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    page = read_page(html or "")
    kept = content_paths(page.root, threshold)
    return " ".join(text for path, text in page.blocks if path in kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            threshold: float = THRESHOLD) -> DataFrame:
    """The columns in ``keep``, ``text`` and ``n_chars`` (code points) of every page."""
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, threshold) for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(F.col(html_col).alias("_h"), *keep).mapInArrow(run, f"{schema}, text string, n_chars bigint")
