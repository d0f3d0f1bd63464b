"""Visible text of any HTML, well formed or not.

One pass over a page: text, tags, comments and raw text in turn, with a stack of what is
open where something is hidden.  Every step moves forward or ends the page, so time is
linear in its length whatever it holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements without content, and those whose content is no markup.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})
#: Raw text that is shown, with its entities read, and what is not shown at all.
SHOWN_RAW = frozenset({"textarea", "title"})
HIDDEN = frozenset({"script", "style", "template", "iframe", "noembed", "noframes"})

#: Pages whose texts are given back together.
PAGES = 64

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
#: One attribute, or what separates two; a quote opens a value only behind an equals sign.
_ATTRIBUTE = re.compile(r"""[\s/]++|[^\s/>](?P<rest>[^\s/>=]*+)(?P<value>\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+""")
_OPEN_QUOTE = re.compile(r"""\s*+=\s*+["']""")
_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in RAW}


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` of the tag whose attributes start here; -1 if it has none."""
    while at < len(page):
        if page[at] == ">":
            return at + 1
        m = _ATTRIBUTE.match(page, at)
        at = m.end()
        if m["rest"] is not None and m["value"] is None and _OPEN_QUOTE.match(page, at):  # a value that never ends takes the rest of the page
            return -1
    return -1


def visible(page: str) -> list[str]:
    """The shown pieces of text of a page, in order, entities read.

    Comments, declarations and instructions go, at an end that is missing with the rest of
    the page, as does a tag without end; an end tag of nothing open is passed over; a ``<``
    before anything else is text.
    """
    out: list[str] = []
    open_: list[str] = []  # what is open inside of hidden elements, those included
    held: Counter[str] = Counter()
    at = begin = 0  # where to look on, and where the text at hand began

    def show(a: int, b: int) -> None:
        if b > a and not open_:
            out.append(unescape(page[a:b]))

    while True:
        found = page.find("<", at)
        if found < 0:
            show(begin, len(page))
            return out
        follows = page[found + 1 : found + 2]
        closing = follows == "/"
        name = _NAME.match(page, found + 1 + closing)
        if name:
            show(begin, found)
            own = name.group().lower()
            at = _tag_end(page, name.end())
            if at < 0:
                return out
            if closing:
                if held[own]:
                    last = None
                    while last != own:
                        last = open_.pop()
                        held[last] -= 1
            elif own in RAW:
                end = _END[own].search(page, at)
                stop = end.start() if end else len(page)
                if own not in HIDDEN and not open_:
                    out.append(unescape(page[at:stop]) if own in SHOWN_RAW else page[at:stop])
                at = stop
            elif own not in VOID and (open_ or own in HIDDEN):
                open_.append(own)
                held[own] += 1
        elif follows in ("!", "?") or closing:
            show(begin, found)
            if page.startswith("<!--", found) and not page.startswith((">", "->"), found + 4):
                end = page.find("-->", found + 4)
                at = end + 3
            else:
                end = page.find(">", found + 2)
                at = end + 1
            if end < 0:
                return out
        else:
            at = found + 1
            continue
        begin = at


@F.arrow_udf(StringType())
def _visible(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for start in range(0, len(batch), PAGES):  # a batch's texts are not all held at once
            pages = (p.as_py() for p in batch.slice(start, PAGES))
            yield pa.array([" ".join(" ".join(visible(p)).split()) if p is not None else "" for p in pages], pa.string())


def visible_text(x: Column) -> Column:
    """Visible text of a page, its pieces parted by one space; a null page gives an empty text."""
    return _visible(x)
