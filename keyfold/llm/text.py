"""Visible words of wiki markup."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*|/)?/?>")
_PIPED = re.compile(r"\[\[(?!(?:[Ff]ile|[Ii]mage):)[^\[\]|{}\n]*\|([^\[\]|]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:)?//[^\s\[\]]+")
#: A template's name before its first argument, or a template without arguments. Longer stretches are text in broken braces.
_TEMPLATE = re.compile(r"\{\{[^{}|\n]{0,40}(?:\||\}\})")
_ARGUMENT = re.compile(r"(?<=\|)\s*[\w -]{1,40}=(?!=)")
_WORD = re.compile(r"[^\W_]+")
#: Tags that stand inside a line of text and don't part words.
INLINE = frozenset("b i u s em strong span small big sub sup font abbr nowiki mark ins del tt code kbd var cite q".split())


#: Bytes of text that a worker takes apart at a time, besides a single text that is longer.
SLICE_BYTES = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes in ``column``, so that a worker's memory doesn't depend on batch sizes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total + n > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def _drop_invisible(s: str) -> str:
    return "".join(c for c in s if unicodedata.category(c) != "Cf")


def _untag(m: re.Match) -> str:
    return "" if m[1].lower() in INLINE else " "


def visible_words(text: str | None) -> list[str]:
    """Words (runs of letters and digits, case folded) of what a reader of the page sees.

    Comments and tags go, of piped links the label stays, character references and letter widths are resolved,
    invisible characters vanish even inside words. Text in cells, quotes and template arguments stays, the names of
    named arguments and those of templates don't. Null and empty text have no words.
    """
    if not text:
        return []
    s = text
    if "<" in s:
        s = _TAG.sub(_untag, _COMMENT.sub("", s))
    if "&" in s:
        s = html.unescape(s)
    if not s.isascii():
        s = unicodedata.normalize("NFKC", s)
        if not s.isprintable():
            s = _drop_invisible(s)
    if "[" in s:
        s = _EXTERNAL.sub(" ", _PIPED.sub(r"\1", s))
    if "{{" in s:
        # The bar stays for the argument's name that may follow.
        s = _TEMPLATE.sub(" | ", s)
    if "=" in s and "|" in s:
        s = _ARGUMENT.sub(" ", s)
    return _WORD.findall(s.casefold())
