"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of tags (with classes). Per path the text length per
block and the punctuation per block are added up; both are smoothed along the order of blocks in the page, fused by
multiplication, and paths at or above a share of the page's fused mean are content paths. The element that holds their text,
and little other text, is the article; an article or main element is preferred if it does so nearly as well. All its
blocks belong to the text, short ones too, and so do blocks of content paths elsewhere, save those under elements that are
never content by their tag or role, or by a whole class or id if they don't hold most of the text (menus, comments, ...).
Work and memory are in proportion to the page's length, however deeply it is nested.

Defined results: an empty or null page has an empty text; an unclosed or cut page is read as far as it goes; a tag cut off
by the end of the page is dropped; unknown tags are inline; repeated pages get one row each; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, url string, text string, n_chars long"
#: A content path has at least this share of the mean fused ratio of the page's text.
THRESHOLD = 0.25
#: An article or main element holds the article if it does so nearly as well as the best element.
MARKED = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset(
    "html head body title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup "
    "hr legend li main menu nav ol option p pre search section select summary table caption colgroup thead tbody tfoot tr td th ul".split()
)
#: Never content, with all they hold.
SKIPPED = frozenset(
    "head title nav footer aside form button select option textarea input label fieldset noscript iframe object svg canvas menu dialog audio video template search".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Whole classes or ids that mark an element as no content, unless it holds most of the page's text.
SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "side rail widget footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus discussion respond reply replies share sharing social related recommended recommendations pagination pager tags copyright "
    "disclaimer skip hidden form search".split()
)
#: Open elements that a new element of these kinds ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
ENDED = HEADINGS | {"p"} | frozenset().union(*ENDS.values())
#: An element isn't ended by what stands inside these.
FENCES = frozenset("table ul ol dl menu select td th div article section main aside nav body html".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[a-zA-Z/!?])[^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


class Element:
    """An element of the page. What its ancestors say about it is carried down, so that nothing walks up to the root."""

    __slots__ = ("tag", "parent", "path", "never", "marked", "inside", "depth", "order", "last", "block", "stop", "marks")

    def __init__(self, tag: str, parent: Element | None, attributes: str, paths: dict, order: int):
        self.tag, self.parent, self.order, self.last = tag, parent, order, order
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.marks = found.get("class", "").lower()
        # A path is the number of its (parent path, tag, classes).
        self.path = paths.setdefault((parent.path if parent else -1, tag, self.marks), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        names = set((self.marks + " " + found.get("id", "").lower()).split())
        self.never = bool(
            parent and parent.never or tag in SKIPPED or (tag == "header" and not self.inside)
            or found.get("role", "").lower() in SKIPPED_ROLES or "hidden" in found or re.search(r"\shidden(\s|$)", attributes)
        )
        self.marked = tag not in ("html", "body", "main") and bool(names & SKIPPED_WORDS)
        # The nearest element that holds a block of its own, and the nearest one that a new element may end or that guards those above.
        self.block = self if parent is None or tag in BLOCK or self.never or self.marked else parent.block
        self.stop = self if parent is None or tag in ENDED or tag in FENCES else parent.stop

    def holds(self, other: Element) -> bool:
        return self.order <= other.order <= self.last


class Page:
    """Blocks of text (element, text) in page order, and all elements, parents first."""

    def __init__(self, page: str):
        self.paths: dict = {}
        self.root = Element("", None, "", self.paths, 0)
        self.elements, self.blocks = [self.root], []
        self._stack, self._open, self._piece = [self.root], Counter(), []
        at = 0
        for m in TOKEN.finditer(page):
            self._piece.append(page[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if tag and m[2]:
                self._end(tag)
            elif tag:
                self._start(tag, m[4] or "")
            elif m[1]:
                self._piece.append(" ")
        self._piece.append(page[at:])
        self._close(1)

    def _flush(self) -> None:
        text = " ".join(html_lib.unescape("".join(self._piece)).split())
        if text:
            self.blocks.append((self._stack[-1].block, text))
        self._piece.clear()

    def _close(self, to: int) -> None:
        self._flush()
        self._drop(to)

    def _drop(self, to: int) -> None:
        for gone in self._stack[to:]:
            self._open[gone.tag] -= 1
            gone.last = len(self.elements) - 1
        del self._stack[to:]

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            if tag in BLOCK:
                self._flush()
            return
        found = next(i for i in range(len(self._stack) - 1, 0, -1) if self._stack[i].tag == tag)
        if self._stack[-1].block.depth >= found:
            self._close(found)
        else:
            self._drop(found)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag in ("br", "wbr"):
                self._piece.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self._flush()
            ended = ENDS.get(tag, frozenset()) | ({"p"} | (HEADINGS if tag in HEADINGS else frozenset()))
            stop = self._stack[-1].stop
            while stop.parent is not None:
                if stop.tag in ended:
                    self._drop(stop.depth)
                elif stop.tag in FENCES:
                    break
                stop = stop.parent.stop
        new = Element(tag, self._stack[-1], attributes, self.paths, len(self.elements))
        if new.block is new and self._stack[-1].block is not new and (new.never or new.marked):
            self._flush()
        self.elements.append(new)
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            self._stack.append(new)
            self._open[tag] += 1

    def below(self, blocks: list[tuple[Element, int]]) -> list[int]:
        """Of each element, by its order, the sum of the numbers of the blocks in it."""
        total = [0] * len(self.elements)
        for element, n in blocks:
            total[element.order] += n
        for element in reversed(self.elements[1:]):
            total[element.parent.order] += total[element.order]
        return total


def content_paths(found: list[tuple[Element, str]]) -> dict[int, float]:
    """Fused ratio of each tag path at or above the threshold."""
    length, punctuation, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for element, text in found:
        length[element.path] += len(text)
        punctuation[element.path] += len(PUNCTUATION.findall(text))
        count[element.path] += 1
    by_block = [(length[e.path] / count[e.path], (1 + punctuation[e.path]) / count[e.path]) for e, _ in found]
    fused = defaultdict(float)
    for i, (element, _) in enumerate(found):
        near = range(max(0, i - 1), min(len(found), i + 2))
        weight = [2 if k == i else 1 for k in near]
        smooth = [sum(w * by_block[k][j] for w, k in zip(weight, near)) / sum(weight) for j in (0, 1)]
        own = by_block[i]
        fused[element.path] += (smooth[0] + own[0]) * (smooth[1] + own[1]) / 4 / count[element.path]
    total = sum(length.values())
    mean = sum(fused[p] * length[p] for p in fused) / total if total else 0
    return {p: v for p, v in fused.items() if v >= THRESHOLD * mean}


def unmarked(page: Page) -> list[tuple[Element, str]]:
    """The blocks that aren't skipped; a class or id alone skips no element that holds most of the text."""
    found = [(e, t) for e, t in page.blocks if not e.never]
    held = page.below([(e, len(t)) for e, t in found])
    gone = [False] * len(held)
    for element in page.elements[1:]:
        gone[element.order] = gone[element.parent.order] or element.marked and 2 * held[element.order] <= held[0]
    return [(e, t) for e, t in found if not gone[e.order]]


def holder(page: Page, found: list[tuple[Element, str]], chosen: dict[int, float]) -> Element:
    """The element that holds the article: the text of content paths should be in it, and little else.

    Both shares count alike (their harmonic mean); an article or main element needs MARKED of the best one's, and of those
    the outermost is taken, else the deepest of the best.
    """
    inside, content = page.below([(e, len(t)) for e, t in found]), page.below([(e, len(t)) for e, t in found if e.path in chosen])
    fit = [2 * c / (n + content[0]) if c else 0.0 for n, c in zip(inside, content)]
    best = max(fit)
    marked = [e for e in page.elements if e.tag in ("article", "main") and fit[e.order] >= MARKED * best]
    if marked:
        return min(marked, key=lambda e: (e.depth, e.order))
    article = max(
        (e for e in page.elements if fit[e.order] >= best and content[e.order] == content[0]), key=lambda e: (e.depth, -e.order),
        default=page.root
    )
    if article.tag in HEADINGS or article.tag == "p":
        article = article.parent or article
    # A heading beside the holder belongs to it when nothing else is there.
    while article.parent is not None and article.parent.tag not in ("", "html", "body"):
        beside = [e for e, _ in found if article.parent.holds(e) and not article.holds(e)]
        if not beside or any(e.tag not in HEADINGS for e in beside):
            break
        article = article.parent
    return article


def main_text(text: str) -> str:
    """The article's blocks, joined by newlines."""
    page = Page(text)
    found = unmarked(page)
    if not found:
        return ""
    chosen = content_paths(found)
    article = holder(page, found, chosen)
    content = page.below([(e, 1) for e, _ in found if e.path in chosen])
    # Of a whole page only the parts with content belong to it.
    whole = article.tag in ("", "html", "body")
    part = [False] * len(page.elements)
    for element in page.elements:
        own = element.parent is article and content[element.order] > 0
        part[element.order] = own or element.parent is not None and part[element.parent.order]
    bare = whole and not any(e.parent is article and content[e.order] for e in page.elements)
    return "\n".join(t for e, t in found if e.path in chosen or e is article or article.holds(e) and (not whole or bare or part[e.order]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64())
                ], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    ).mapInArrow(run, RESULT)
