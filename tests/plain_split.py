"""Splitting one script at a time in plain Python, for comparison."""

from __future__ import annotations

import re

from tidemark.functions.names import WHITE_SPACE
from tidemark.functions.statements import (
    _ESCAPED,
    _PLAIN,
    _QUOTES,
    _TAG,
    OPEN_COMMENT,
    OPEN_DOLLAR,
    OPEN_IDENTIFIER,
    OPEN_STRING,
)

_TOKEN = re.compile(rf"{_PLAIN}|--[^\n]*+|/\*|{_QUOTES}|[\s\S]")
_COMMENT_EDGE = re.compile(r"\*/|/\*")


def _comment_end(text: str, at: int) -> int | None:
    """Offset after the block comment opened before ``at``, counting nested ones."""
    depth = 1
    for edge in _COMMENT_EDGE.finditer(text, at):
        depth += 1 if edge.group() == "/*" else -1
        if depth == 0:
            return edge.end()
    return None


def split_nested_text(text: str) -> tuple[list[str] | None, str | None]:
    """The same split for one script whose comments nest."""
    out: list[str] = []
    start, at = None, 0
    while at < len(text):
        piece = _TOKEN.match(text, at)
        token, end = piece.group(), piece.end()
        head = token[:1]
        if token == "/*":
            end = _comment_end(text, end)
            if end is None:
                return None, OPEN_COMMENT
        elif token == ";":
            if start is not None:
                out.append(text[start:at].strip(WHITE_SPACE))
            start = None
        elif not token.startswith("--"):
            if head in "'\"" and (len(token) < 2 or token[-1] != head):
                return None, OPEN_STRING if head == "'" else OPEN_IDENTIFIER
            if token[1:2] == "'" and head in "eE" and not re.fullmatch(_ESCAPED, token):
                return None, OPEN_STRING
            tag = re.match(rf"\$({_TAG})\$", token)
            if tag and not token.endswith(tag.group(), tag.end()):
                return None, OPEN_DOLLAR % tag.group(1)
            blank = len(token) - len(token.lstrip(" \t\n\f\r"))
            if start is None and blank < len(token):
                start = at + blank
        at = end
    if start is not None:
        out.append(text[start:].strip(WHITE_SPACE))
    return [s for s in out if s], None
