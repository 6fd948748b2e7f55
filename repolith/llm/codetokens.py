"""Lexical tokens of source code, by family of languages, for finding literals by the identifiers that they are assigned or passed to.

A token is (kind, start, end): n identifier, s string with delimiters, c comment, d number, o mark. A string knows its delimiters, whether it is raw, and the
holes in which expressions stand. What can't be read is a mark of one character, so that damaged files have tokens too.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Extensions of languages whose comments begin with #.
HASH_COMMENTS = frozenset("py rb".split())

_string = (
    r"(?P<s>(?:[rRbBuUfF]{1,2}(?=[\"']))?(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*+'''"
    r"|\"(?:[^\\\"\n]|\\[\s\S])*+\"|'(?:[^\\'\n]|\\[\s\S])*+'|`(?:[^\\`]|\\[\s\S])*+`))"
)
_rest = r"|(?P<n>[^\W\d][\w$]*|\$[\w$]+)|(?P<d>\d[\w.]*)|(?P<o>:=|=>|==+|!=+|\|\||\?\?|::|->|\S)"
_hash_tokens = re.compile(r"(?P<c>#[^\n]*)|" + _string + _rest)
_slash_tokens = re.compile(r"(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)|" + _string + _rest)
_opening = re.compile(r"([rRbBuUfF]{0,2})(\"\"\"|'''|[\"'`])")
_format_hole = re.compile(r"\{\{|\}\}|\{[^{}]*\}")


class Token(NamedTuple):
    kind: str
    start: int
    end: int


def tokens(text: str, extension: str) -> list[Token]:
    pattern = _hash_tokens if extension in HASH_COMMENTS else _slash_tokens
    return [Token(m.lastgroup, m.start(), m.end()) for m in pattern.finditer(text)]


def contents(text: str, token: Token) -> list[tuple[int, int]]:
    """The places of a string's own characters, without its delimiters and without the holes of a formatted string."""
    m = _opening.match(text, token.start)
    begin, end = m.end(), token.end - len(m.group(2))
    if "f" not in m.group(1).lower():
        return [(begin, end)]
    return outside_holes(text, begin, end)


def outside_holes(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """text[begin:end] without {expressions}; doubled braces are characters."""
    kept, at = [], begin
    for hole in _format_hole.finditer(text, begin, end):
        if hole.group() not in ("{{", "}}"):
            kept.append((at, hole.start()))
            at = hole.end()
    return [(a, b) for a, b in [*kept, (at, end)] if a < b]
