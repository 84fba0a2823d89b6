"""The article in a page: a tag-stack reader that stands broken HTML, and a choice of blocks by words and share of link text.

The page is read once by the standard library's tokenizer. Open tags are kept on a stack; an end tag closes all down to its partner and is ignored
without one, so an unclosed tag ends with what surrounds it. A block is the text between two tags that break lines. Blocks in scripts, styles,
heads, navigation, headers, footers, asides, forms and the like are left out; the others are told apart by the published rule of shallow text features (words and link density of
a block and its neighbours; Kohlschütter, Fankhauser and Nejdl, 2010). Work is in proportion to the page, a page at a time in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = frozenset("address article blockquote body br center dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol option p pre section table tbody tfoot thead title tr ul".split())
LEFT_OUT = frozenset("aside button canvas footer form head header iframe menu nav noscript object script select style svg template textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A new one of these ends an open one of the same name.
ALONE = frozenset("dd dt li option p td th tr".split())


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, int, float]] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, len(text.split(" ")), min(1.0, self.linked / len(text.split(" ")))))
        self.parts, self.linked = [], 0

    def _push(self, tag: str) -> None:
        self.open.append(tag)
        self.count[tag] += 1
        self.hidden += tag in LEFT_OUT

    def _close(self, tag: str) -> None:
        while True:
            last = self.open.pop()
            self.count[last] -= 1
            self.hidden -= last in LEFT_OUT
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS or tag in LEFT_OUT:
            self.end_block()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in ALONE and self.open and self.open[-1] == tag:
            self._close(tag)
        self._push(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self.end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS or tag in LEFT_OUT:
            self.end_block()
        if self.count[tag]:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data.split())


def _is_content(before: tuple, block: tuple, after: tuple) -> bool:
    (_, words_before, links_before), (_, words, links), (_, words_after, _) = before, block, after
    if links > 1 / 3:
        return False
    if links_before <= 5 / 9:
        return words > 16 or words_after > 15 or words_before > 4
    return words > 40 or words_after > 17


def article(html: str | None) -> str | None:
    """The article's blocks, a line each; None for null, empty where no block is content."""
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    page.end_block()
    none = ("", 0, 0.0)
    around = zip([none, *page.blocks[:-1]], page.blocks, [*page.blocks[1:], none], strict=True) if page.blocks else []
    return "\n".join(block[0] for before, block, after in around if _is_content(before, block, after))


def article_text(html: Column) -> Column:
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pages.map(article)

    # made where a session is
    return F.pandas_udf(each, "string")(html)
