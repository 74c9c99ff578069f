"""Blocks of text of a web page: a small tag walker, no tree is built."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

#: Elements that do not end a block, that have no end, and whose content is not text.
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that a new one of these kinds ends, if it is open.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

#: Elements open at once, at most; one more takes the place of the innermost, as in browsers.
DEPTH = 512

_CUT = (
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<[!?][^>]*+>"
)
_TEXT = r"|(?P<text>[^<]++|<)"
_START = r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
TOKEN = re.compile(_CUT + _START + r"""(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""" + r"|(?P<open><(?=/?[a-zA-Z]))" + _TEXT, re.S | re.I)
#: The same, but a tag is matched up to its name only.
START = re.compile(_CUT + _START + _TEXT, re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")


class Block(NamedTuple):
    """``path`` names the elements around the block and their classes, ids and roles."""

    path: tuple[str, ...]
    text: str
    link_share: float


def _names(tag: str, rest: str) -> tuple[str, ...]:
    named = [x for value in _NAMED.findall(rest) for x in _TOKEN.findall(value.lower())] if rest else []
    return (f"<{tag}>", *named)


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes, or at the first one if quotes do not close."""

    def __init__(self, html: str, start: int, stop: int):
        self.html = html
        marks = [(m.start(), m[0]) for m in re.compile(r"""[>"']""").finditer(html, start, stop)]
        self.places = [at for at, _ in marks]
        self.ends = [-1] * (len(marks) + 1)
        following: dict[str, int] = {}
        for k in range(len(marks) - 1, -1, -1):
            at, mark = marks[k]
            if mark == ">":
                self.ends[k] = at
            else:
                if mark in following:
                    self.ends[k] = self.ends[following[mark] + 1]
                following[mark] = k

    def after(self, at: int) -> int:
        end = self.ends[bisect_left(self.places, at)]
        return self.html.index(">", at) if end < 0 else end


def _tokens(html: str) -> Iterator[tuple[str | None, str, bool, str]]:
    """(text, tag, closing, attributes) in page order, in time linear in the page, however broken.

    Behind the last ``>`` no tag can end, so what is there is text, or an open comment. The first tag
    whose quotes do not close makes a table of where tags end, so that none is looked for to the end again.
    """
    stop = html.rfind(">") + 1
    at, ends, whole = 0, None, True
    while at < stop:
        for m in (TOKEN if ends is None else START).finditer(html, at, stop):
            at = m.end()
            if m["text"] is not None:
                yield m["text"], "", False, ""
            elif m["tag"]:
                if ends is None:
                    yield None, m["tag"].lower(), bool(m["end"]), m["rest"]
                    continue
                end = ends.after(at)
                rest, at = html[at:end], end + 1
                yield None, m["tag"].lower(), bool(m["end"]), rest
                break
            elif ends is None and m["open"]:
                at = m.start()
                ends = TagEnds(html, at, stop)
                break
            elif m["raw"]:
                whole = re.search(rf"</{m['raw']}\s*+>\Z", m[0], re.I) is not None
            elif m[0].startswith("<!--"):
                whole = len(m[0]) > 6 and m[0].endswith("-->")
    if whole:
        yield html[stop:].split("<!--", 1)[0], "", False, ""


def page_blocks(html: str) -> list[Block]:
    """Blocks in page order; white space inside a block is one space, character references are decoded."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            path = stack[-1][1] if stack else ()
            found.append(Block(paths.setdefault(path, path), text, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    for spoken, tag, closing, rest in _tokens(html):
        if spoken is not None:
            piece = unescape(spoken)
            pieces.append(piece)
            linked += len(piece) if links else 0
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                pieces.append(" ")
            continue
        flush()
        links = 0
        if closing:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                del stack[at:]
            continue
        if stack and (stack[-1][0] == "p" or tag in ENDED_BY.get(stack[-1][0], ())):
            stack.pop()
        if tag not in VOID:
            if len(stack) == DEPTH:
                stack.pop()
            stack.append((tag, (stack[-1][1] if stack else ()) + _names(tag, rest)))
    flush()
    return found
