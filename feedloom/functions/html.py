"""Text of web pages: one linear pass over a page's tags with a stack of open elements.

Spark has no HTML parser and no table of character references, so this is a vectorised function
over Arrow batches; everything around it stays in the engine.
"""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lookups as L

#: One token of a page: a comment, a declaration or instruction, a tag with its attributes, or a run of text. No alternative can fail after it has
#: run on, so that reading is linear; a comment, tag or quoted value that is never closed ends with the page.
_TOKEN = re.compile(
    r"""(?P<comment><!--(?:>|->|.*?(?:--!?>|\Z)))|(?P<other><[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z))"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=)*+)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in L.RAW_TAGS}
_DROPPED = frozenset(L.DROPPED_TAGS) | frozenset(L.SILENT_TAGS)
_SPACE = re.compile(r"\s+")
_NAMED = re.compile(r"&([a-zA-Z][a-zA-Z0-9]*)(;?)")


def _closed_only(text: str) -> str:
    """The text with the ampersand escaped of every named reference that is unknown or lacks its semicolon."""
    return _NAMED.sub(lambda m: m[0] if m[2] and f"{m[1]};" in html.entities.html5 else f"&amp;{m[0][1:]}", text)


def page_text(page: str | None, closed: bool = False) -> str:
    """Text outside dropped elements, runs joined by spaces, references decoded, white space collapsed.

    With ``closed`` a named reference without its semicolon is text, as it is to the parser of libxml2 before 2.14; else old names do without, as in HTML 5.

    An element lasts to its end tag, to that of an element around it, or to the end of the page. An end tag without an
    open element is ignored, also where an open element that holds more (``L.END_PRIORITY``) stands between. Elements that hold
    nothing, and tags closed in themselves, don't open. A form within a form ends the outer one.
    """
    runs: list[str] = []
    run: list[str] = []
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where each name stands in the stack
    dropped = at = 0
    page = page or ""
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"]:
            if not dropped:
                run.append(m["text"])
            continue
        if run:  # whatever stands between two runs of text parts them
            runs.append("".join(run))
            run = []
        if not m["name"]:
            continue
        name, keep = m["name"].lower(), len(stack)
        if m["end"]:
            if not places.get(name):
                continue
            last, weight = places[name][-1], L.END_PRIORITY.get(name, 100)
            if any(w > weight and places.get(x) and places[x][-1] > last for x, w in L.END_PRIORITY.items()):
                continue
            keep = last
        elif name in L.VOID_TAGS or m["rest"].endswith("/"):
            continue
        elif name == "form" and stack and stack[-1] == "form":
            keep -= 1
        for x in stack[keep:]:
            places[x].pop()
            dropped -= x in _DROPPED
        del stack[keep:]
        if not m["end"]:
            places.setdefault(name, []).append(len(stack))
            stack.append(name)
            dropped += name in _DROPPED
            if name in _RAW_END:
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
    runs.append("".join(run))
    return _SPACE.sub(" ", " ".join([html.unescape(_closed_only(r) if closed else r) for r in runs])).strip()


@F.pandas_udf(StringType())
def _text(pages: pd.Series) -> pd.Series:
    return pages.map(page_text)


@F.pandas_udf(StringType())
def _closed_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: page_text(p, closed=True))


def sanitize(page: Column, closed: bool = False) -> Column:
    """Text of a page without scripts, navigation, forms and frames around it; empty for null. ``closed``: see ``page_text``."""
    return _closed_text(page) if closed else _text(page)
