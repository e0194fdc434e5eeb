"""The spoken part of a document's text, and its words."""

from __future__ import annotations

import re

TIMED = ("srt", "webvtt")
WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^>]*>")


def spoken_line(line: str, timed: bool, first: bool = False) -> str:
    """The trimmed spoken text of one line, empty if nothing of it is spoken."""
    if timed:
        if first and line.startswith("WEBVTT"):
            return ""
        if "-->" in line:
            return ""
        bare = line.strip()
        if bare.isascii() and bare.isdigit():
            return ""
        if "<" in line:
            # a tag closes at the latest at the last ">": so no opener is searched in vain, and time stays linear
            last = line.rfind(">") + 1
            line = _TAG.sub("", line[:last]) + line[last:]
    return line.strip()


def spoken_lines(text: str, document_format: str | None) -> list[str]:
    """The spoken lines: timed formats lose header, timing and number lines and tags; blank lines go."""
    timed = document_format in TIMED
    found = (spoken_line(x, timed, i == 0) for i, x in enumerate(text.split("\n")))
    return [x for x in found if x]


def words(text: str) -> list[str]:
    """The maximal runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower())
