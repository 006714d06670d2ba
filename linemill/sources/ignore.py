"""Ignore files: from their text to rules.

Texts and paths that aren't UTF-8 come as the operating system's functions give
them (``os.fsdecode``); matching is on their bytes.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from linemill.functions.glob import for_python, to_regex


@dataclass(frozen=True)
class Rule:
    """regex matches the path below the file's directory if anchored, else the last component."""

    regex: str
    negated: bool
    dir_only: bool
    anchored: bool

    def matches(self, relative: str, is_dir: bool) -> bool:
        if self.dir_only and not is_dir:
            return False
        text = relative if self.anchored else relative.rpartition("/")[2]
        return bool(for_python(self.regex).match(os.fsencode(text).decode("latin-1")))


def _unpadded(line: str) -> str:
    """Without the spaces and tabs at its end that no backslash keeps."""
    while line[-1:] in (" ", "\t") and line:
        if len(re.search(r"\\*$", line[:-1])[0]) % 2:
            break
        line = line[:-1]
    return line


def parse(text: str) -> list[Rule]:
    rules = []
    for raw in text.split("\n"):
        line = raw.rstrip("\r\n")
        if not line or line[0] == "#":
            continue
        line = _unpadded(line)
        negated = line[:1] == "!"
        line = line[negated:]
        dir_only = line[-1:] == "/"
        line = line[: len(line) - dir_only]
        while line[-1:] == " " and line[-2:-1] != "\\":
            line = line[:-1]
        rooted = line[:1] == "/"
        line = line[rooted:]
        if line:
            rules.append(Rule(to_regex(line), negated, dir_only, rooted or "/" in line))
    return rules


def ignored(chain: list[tuple[str, list[Rule]]], path: str, is_dir: bool) -> bool:
    """chain: (directory, rules) from the root down. The last rule that matches decides; 128 levels count."""
    out = False
    for directory, rules in chain[-128:]:
        relative = path[len(directory) + 1 :]
        for rule in rules:
            if rule.matches(relative, is_dir):
                out = not rule.negated
    return out
