"""Title, content and main area of HTML pages.

A page is read once, in order. Every element inherits its parent's marks and adds its own: what it is within
(an article, a script, an element whose class names content) is a set of bits, so a selector is a test of a text's
bits, and no tree is kept or walked. Blocks (paragraphs, sections, cells) are numbered for the scored main area.

The cascade takes the first selector that gives more than ``ENOUGH`` characters: the first article of its parent,
main, a class that names content, an id that does; then paragraphs, then all visible text.

The main area is the block that scores highest: a paragraph of some length gives points for its length and commas to
the block that holds it, half of them to the next one up; what stands in links counts against a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters that a selector must give, and that a title has at least.
ENOUGH, LEAST_TITLE = 200, 6
#: The words of classes and ids that name content, and the names of headlines.
CONTENT_CLASSES, CONTENT_IDS, HEADLINES = ("content", "article", "post"), ("content", "article", "main"), ("title", "headline")
NO_TITLE = "No Title Found"

_NAMES = ("script", "style", "nav", "header", "footer", "aside", "form", "main", "p", "title", "h1", "h2", "a", "beside", "first_article", "content_class", "content_id", "headline_class", "headline_id")
BIT = {name: 1 << i for i, name in enumerate(_NAMES)}


def _bits(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: (name, what a text must be within, what it mustn't be within), in their order.
CASCADE = [
    ("article", _bits("first_article"), _bits("script", "style", "nav", "header", "footer")),
    ("main", _bits("main"), _bits("script", "style", "nav")),
    ("class", _bits("content_class"), _bits("script", "style")),
    ("id", _bits("content_id"), _bits("script", "style")),
]
PARAGRAPHS, VISIBLE = ("paragraphs", _bits("p"), _bits("script", "style")), ("visible", 0, _bits("script", "style", "nav"))
TITLES = ("title", "h1", "h2", "headline_class", "headline_id")
#: What is never a page's main area.
FRAME = _bits("script", "style", "nav", "header", "footer", "aside", "form", "beside")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("article blockquote body dd div dl dt fieldset figure form h1 h2 h3 h4 h5 h6 header footer li main nav ol p pre section table td th tr ul aside".split())
#: Elements that end with the next of their kind, or with the end of what holds them.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("article blockquote body div dl fieldset form main nav ol section table td th ul aside header footer".split())
#: Names in classes and ids that speak for a block, or against it.
FOR, AGAINST, NAMED = ("content", "article", "post", "body", "entry", "text", "main"), ("comment", "sidebar", "footer", "menu", "promo", "related", "share", "sponsor", "widget", "advert", "banner", "cookie"), 25.0
ADS = frozenset(("ad", "ads"))
PARAGRAPH_CHARS = 25


@dataclass
class Block:
    above: int
    bonus: float
    chars: int = 0
    linked: int = 0
    commas: int = 0


@dataclass
class Text:
    bits: int
    block: int
    said: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.said)


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: Open elements: (tag, bits, block, articles among its children so far).
        self.open: list[list] = [["", 0, 0, 0]]
        self.held: Counter[str] = Counter()
        self.blocks, self.texts, self.joins = [Block(-1, 0.0)], [], False
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # the parser knows no section of that kind
            self.__init__(html.replace("<![", "&lt;!["))

    def _close(self, i: int) -> None:
        self.held.subtract(x[0] for x in self.open[i:])
        del self.open[i:]

    def _end(self, tags: set[str] | frozenset[str]) -> None:
        """Closes the nearest open one of these, if it is in the same holder."""
        if not any(self.held[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self._close(i)
                return
            if self.open[i][0] in HOLDERS:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.joins = False
        if tag in SIBLINGS:
            self._end(SIBLINGS[tag])
        elif tag in BLOCKS:
            self._end({"p"})
        if tag in VOID:
            return
        given = {k: v or "" for k, v in reversed(attrs)}
        kind, name, parent = given.get("class", ""), given.get("id", ""), self.open[-1]
        bits = parent[1] | BIT.get(tag, 0)
        if tag == "article":
            parent[3] += 1
            bits |= BIT["first_article"] if parent[3] == 1 else 0
        for mark, value, words in (("content_class", kind, CONTENT_CLASSES), ("content_id", name, CONTENT_IDS)):
            bits |= BIT[mark] if any(w in value for w in words) else 0
        bits |= (BIT["headline_class"] if kind in HEADLINES else 0) | (BIT["headline_id"] if name in HEADLINES else 0)
        block = parent[2]
        if tag in BLOCKS:
            named = f"{kind} {name}".lower()
            good, bad = any(w in named for w in FOR), any(w in named for w in AGAINST) or not ADS.isdisjoint(named.split())
            self.blocks.append(Block(block, NAMED * (good - bad)))
            # what stands beside the content, unless it may well hold it
            bits |= BIT["beside"] if bad and not good and tag not in ("body", "main", "article") else 0
            block = len(self.blocks) - 1
        self.open.append([tag, bits, block, 0])
        self.held[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # as in pages of old, the slash at the end of a tag says nothing
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.joins = False
        if not self.held[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._close(i)
                return

    def handle_comment(self, data: str) -> None:
        self.joins = False

    def handle_data(self, data: str) -> None:
        _, bits, block, _ = self.open[-1]
        if not self.joins:
            self.texts.append(Text(bits, block))
            self.joins = True
        self.texts[-1].said.append(data)
        n, b = len(data.strip()), self.blocks[block]
        b.chars += n
        b.linked += n if bits & BIT["a"] else 0
        b.commas += data.count(",")

    def within(self, inside: int, outside: int) -> list[str]:
        return [t.text for t in self.texts if t.bits & inside == inside and not t.bits & outside]


def collapsed(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def title(page: Page) -> str:
    """The first text of the first kind of title that has one long enough."""
    for mark in TITLES:
        first = next(iter(page.within(BIT[mark], 0)), "").strip()
        if len(first) >= LEAST_TITLE:
            return first
    return NO_TITLE


def content(page: Page) -> tuple[str, str]:
    """Which step of the cascade gave the content, and the content."""
    for name, inside, outside in CASCADE:
        text = collapsed(page.within(inside, outside))
        if len(text) > ENOUGH:
            return name, text
    paragraphs = page.within(*PARAGRAPHS[1:])
    if paragraphs:
        return PARAGRAPHS[0], collapsed(paragraphs)
    return VISIBLE[0], collapsed(page.within(*VISIBLE[1:]))


def main_area(page: Page) -> str:
    """The texts of the block that scores highest, but for blocks of links in it; '' where no block has a paragraph."""
    n = len(page.blocks)
    points, chars, linked, used = [0.0] * n, [b.chars for b in page.blocks], [b.linked for b in page.blocks], [False] * n
    framed = {t.block for t in page.texts if t.bits & FRAME}
    for i, b in enumerate(page.blocks):
        if b.chars >= PARAGRAPH_CHARS and b.above >= 0 and i not in framed:
            own = 1 + b.commas + min(b.chars // 100, 3)
            for share, at in ((1.0, b.above), (0.5, page.blocks[b.above].above)):
                if at >= 0:
                    points[at] += own * share
                    used[at] = True
    for i in range(n - 1, 0, -1):  # blocks stand behind those that hold them
        chars[page.blocks[i].above] += chars[i]
        linked[page.blocks[i].above] += linked[i]
    dense = lambda i: linked[i] / chars[i] if chars[i] else 0.0
    scored = [((points[i] + page.blocks[i].bonus) * (1 - dense(i)), -i) for i in range(n) if used[i]]
    if not scored:
        return ""
    best = -max(scored)[1]
    inside = [False] * n
    for i in range(best, n):
        inside[i] = i == best or inside[page.blocks[i].above]
    return collapsed([t.text for t in page.texts if inside[t.block] and not t.bits & FRAME and (t.block == best or dense(t.block) <= 0.5)])


def page_parts(html: str | None) -> dict[str, str]:
    """title, strategy, text and main_text of a page; of a null one no title, and nothing else."""
    page = Page(html or "")
    strategy, text = content(page)
    return {"title": title(page), "strategy": strategy, "text": text, "main_text": main_area(page)}


PARTS = ("title", "strategy", "text", "main_text")


@F.pandas_udf(StructType([StructField(name, StringType()) for name in PARTS]))
def page_parts_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_parts(h) for h in html], columns=PARTS)


#: Pages that are read and sent back at once.
PAGES_AT_ONCE = 128


def with_article(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``title`` and ``text``: the main area's, or the content's where no block has paragraphs. A few pages at a time
    are read and sent back, whatever a batch holds."""
    kept, at = [c for c in pages.columns if c not in ("title", "text")], pages.columns.index(html)
    places = [pages.columns.index(c) for c in kept]
    schema = StructType([*[pages.schema[c] for c in kept], StructField("title", StringType()), StructField("text", StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(i, PAGES_AT_ONCE)
                found = []
                for h in part.column(at):
                    page = Page(h.as_py() or "")
                    found.append((title(page), main_area(page) or content(page)[1]))
                yield pa.RecordBatch.from_arrays([*[part.column(j) for j in places], *[pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]], names=schema.names)
        pa.default_memory_pool().release_unused()

    return pages.mapInArrow(read, schema)
