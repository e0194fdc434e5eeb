"""A text as the lines of a narrow view: wrapped by what it takes on a screen, and only as far as the view reaches."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

from cuespark.functions.unsafe import UNSAFE_CHARACTERS

try:
    import regex

    _CLUSTER = regex.compile(r"\r\n|\X")
except ImportError:  # a base with the marks and joiners after it
    _CLUSTER = re.compile(r"\r\n|(?s:.)[\u0300-\u036f\u200d\ufe0e\ufe0f]*")

LOST = "�"
# Bytes that one cluster may have; clusters without width that a line may have, in bytes at least and per column.
MOST_BYTES, INVISIBLE, INVISIBLE_PER_COLUMN = 256, 64, 8
_NO_WIDTH = ("Mn", "Me", "Cf", "Cc")


class LineWindow(NamedTuple):
    """The visible lines, whether there are more before and after them, and where they begin."""

    lines: list[str]
    before: bool
    after: bool
    offset: int


def cluster_width(cluster: str) -> int:
    """The columns that a grapheme cluster takes: its widest character's; an emoji presentation takes two."""
    if "\ufe0f" in cluster or (len(cluster) > 1 and "\U0001f1e6" <= cluster[0] <= "\U0001f1ff"):
        return 2
    return max(0 if unicodedata.category(c) in _NO_WIDTH else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in cluster)


def _shown(cluster: str, width: int) -> tuple[str, int]:
    """A cluster as it is shown, and its width: what is too long, too wide or could act on a terminal becomes U+FFFD."""
    if len(cluster.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        return LOST, 1
    safe = UNSAFE_CHARACTERS.sub(LOST, cluster)
    columns = cluster_width(safe)
    return (LOST, 1) if columns > width else (safe, columns)


def wrapped(text: str, width: int) -> Iterator[str]:
    """The lines of ``text``, made one by one; breaks in the text are kept, and a text without any character is one empty line."""
    line: list[str] = []
    columns = invisible = 0
    most, any_line = max(INVISIBLE, width * INVISIBLE_PER_COLUMN), False
    for found in _CLUSTER.finditer(text):
        cluster = found.group()
        if cluster in ("\n", "\r", "\r\n"):
            yield "".join(line)
            line, columns, invisible, any_line = [], 0, 0, True
            continue
        safe, wide = _shown(cluster, width)
        if wide == 0:
            invisible += len(safe.encode("utf-8", "surrogatepass"))
            if invisible > most:  # a run without width is bounded too
                safe, wide, invisible = LOST, 1, most
        if columns and columns + wide > width:
            yield "".join(line)
            line, columns, invisible, any_line = [], 0, 0, True
        line.append(safe)
        columns += wide
    if line or not any_line:
        yield "".join(line)


def line_window(text: str, width: int, offset: int, count: int) -> LineWindow:
    """``count`` lines from ``offset`` on; an offset beyond the end gives the last lines. Nothing after the window but one line is made."""
    if width <= 0 or count <= 0:
        return LineWindow([], False, False, 0)
    offset, lines = max(0, offset), wrapped(text, width)
    skipped: deque[str] = deque(itertools.islice(lines, 0), maxlen=count)
    made = 0
    for line in itertools.islice(lines, offset):
        skipped.append(line)
        made += 1
    view = list(itertools.islice(lines, count))
    if not view:
        return LineWindow(list(skipped), made > len(skipped), False, made - len(skipped))
    return LineWindow(view, offset > 0, next(lines, None) is not None, offset)
