"""Pages as an HTML parser sees them: visible text and links.

Which end tag closes which element needs a stack, and a text is visible if no dropped element is on it; no built-in function
keeps one in time proportional to the page, so this is a small helper for batches of pages. Rules: names in any
case; comments, declarations and what script and style hold are no text; an end tag closes the last open element
of its name with all inside it, and is nothing where none is open; void elements hold nothing; what stays open
ends with the page; quoted attribute values may hold `>`; character references are decoded once, all that HTML names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Elements that page cleaning drops with all they hold (fixed values).
DROPPED_ELEMENTS = ("script", "style", "nav", "footer", "iframe", "aside", "header", "meta", "link")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style")
_QUOTED = r""""[^"<]*"|'[^'<]*'"""
#: A tag whose quotes close before the next `<`, else one up to the next `>`.
_TAG = re.compile(rf"""<(/?)([A-Za-z][^\s/>]*)((?:{_QUOTED}|[^"'<>])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<!--|<[!?][^>]*>""")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_ATTRIBUTE = re.compile(rf"""([^\s=/"'<>]+)(?:\s*=\s*({_QUOTED}|[^\s"'>][^\s>]*))?""")


def _events(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in order of the page."""
    at, last = 0, page.rfind(">")
    while at < len(page):
        found = _TAG.search(page, at) if at <= last else None
        if found is None:
            break
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            yield "text", "", ""
        elif (name := (found[2] or found[5] or "").lower()) == "":
            yield "text", "", ""
        elif found[1] or found[4]:
            yield "close", name, ""
        else:
            yield "open", name, found[3] or found[6] or ""
            if name in _RAW:
                end = _END[name].search(page, at)
                at = len(page) if end is None else end.end()
                yield "close", name, ""
    if at < len(page):
        yield "text", page[at:], ""


def visible_text(page: str | None) -> str | None:
    """The texts between tags, stripped, a line each; null stays null."""
    if page is None:
        return None
    lines: list[str] = []
    stack: list[str] = []
    count: Counter[str] = Counter()
    dropped = 0
    for kind, value, _ in _events(page):
        if kind == "text":
            if not dropped and (line := unescape(value).strip()):
                lines.append(line)
        elif kind == "open":
            if value not in _VOID:
                stack.append(value)
                count[value] += 1
                dropped += value in DROPPED_ELEMENTS
        elif count[value]:
            while True:
                name = stack.pop()
                count[name] -= 1
                dropped -= name in DROPPED_ELEMENTS
                if name == value:
                    break
    return "\n".join(lines)


def link_targets(page: str | None) -> list[str]:
    """The href of every a element that has one, decoded, in order."""
    out = []
    for kind, name, attributes in _events(page or ""):
        if kind == "open" and name == "a":
            values = [value for key, value in _ATTRIBUTE.findall(attributes) if key.lower() == "href"]
            if values:  # of repeated attributes the last counts
                out.append(unescape(values[-1][1:-1] if values[-1][:1] in ("'", '"') else values[-1]))
    return out


@F.pandas_udf(StringType())
def visible_text_of(pages: pd.Series) -> pd.Series:
    return pages.map(visible_text)


@F.pandas_udf(ArrayType(StringType()))
def link_targets_of(pages: pd.Series) -> pd.Series:
    return pages.map(link_targets)
