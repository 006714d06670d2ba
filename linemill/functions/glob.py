"""Globs as regular expressions for Java and Python alike.

Patterns and paths are matched as bytes: both go through Latin-1 (``as_bytes``).
``*`` stays inside a path component, two or more stars do not; a component
between stars matches at its first place and is never tried again, hence the
atomic groups. ``?`` and classes match one byte other than a slash.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(c: Column) -> Column:
    """A character for each UTF-8 byte."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _char(c: str) -> str:
    return f"\\x{ord(c):02x}"


def _class(pattern: str, at: int) -> tuple[str, int] | None:
    """The class that opens at ``at`` and where it ends; None if it never closes."""
    i = at + 1
    negated = pattern[i : i + 1] in ("!", "^") and pattern[i : i + 1] != ""
    i += negated
    first, parts = i, []
    while i < len(pattern) and (pattern[i] != "]" or i == first):
        low = high = pattern[i]
        if pattern[i + 1 : i + 2] == "-" and pattern[i + 2 : i + 3] not in ("", "]"):
            high = pattern[i + 2]
            i += 2
        low, high = sorted((low, high))
        parts.append(_char(low) if low == high else f"{_char(low)}-{_char(high)}")
        i += 1
    if i >= len(pattern):
        return None
    return f"(?!/)[{'^' if negated else ''}{''.join(parts)}]", i + 1


def to_regex(glob: str) -> str:
    """The expression that matches a whole path when the glob does."""
    text = os.fsencode(glob).decode("latin-1")
    gaps: list[str] = []
    pieces = [""]
    i = 0
    while i < len(text):
        c = text[i]
        if c == "*":
            run = re.compile(r"\*+").match(text, i).end() - i
            gaps.append(r"[\s\S]*" if run > 1 else "[^/]*")
            pieces.append("")
            i += run
            continue
        if c == "\\" and i + 1 < len(text):
            piece, i = _char(text[i + 1]), i + 2
        elif c == "?":
            piece, i = "[^/]", i + 1
        elif c == "[" and (found := _class(text, i)):
            piece, i = found
        else:
            piece, i = _char(c), i + 1
        pieces[-1] += piece
    middle = "".join(f"(?>{gap}?{piece})" for gap, piece in zip(gaps[:-1], pieces[1:-1], strict=True))
    return rf"\A{pieces[0]}{middle}{gaps[-1] if gaps else ''}{pieces[-1] if gaps else ''}\z"


def for_python(regex: str) -> re.Pattern:
    return re.compile(regex.removesuffix(r"\z") + r"\Z")
