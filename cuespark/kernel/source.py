"""Subtitle bytes as text lines that know their place in the bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from cuespark.kernel import messages as M
from cuespark.kernel.texts import trim

_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|\Z)")
_BOMS = ((b"\xff\xfe", "utf-16le-bom", "utf-16-le", "UTF-16LE"), (b"\xfe\xff", "utf-16be-bom", "utf-16-be", "UTF-16BE"))


class Malformed(Exception):
    """A file that can't be used: the message and, where there is one, the line number (else 0)."""

    def __init__(self, message: str, line: int = 0):
        super().__init__(message)
        self.message, self.line = message, line


@dataclass(frozen=True)
class Line:
    """A line without its terminator; ``start`` and ``next`` are byte offsets, ``next`` after the terminator."""

    number: int
    text: str
    start: int
    next: int

    @property
    def blank(self) -> bool:
        return trim(self.text) == ""


@dataclass(frozen=True)
class Source:
    """A decoded file: ``encoding`` (utf-8, utf-8-bom, utf-16le-bom, utf-16be-bom) and its lines."""

    encoding: str
    lines: list[Line]

    @property
    def width(self) -> int:
        """Bytes of an ASCII character."""
        return 2 if self.encoding.startswith("utf-16") else 1

    def encode(self, text: str) -> bytes:
        codec = {"utf-16le-bom": "utf-16-le", "utf-16be-bom": "utf-16-be"}.get(self.encoding, "utf-8")
        return text.encode(codec)


def _utf16(payload: bytes, codec: str) -> str:
    if len(payload) % 2:
        raise Malformed(M.ODD_UTF16)
    try:
        return payload.decode(codec)
    except UnicodeDecodeError as e:
        unit = int.from_bytes(payload[e.start : e.start + 2], "little" if codec.endswith("le") else "big")
        raise Malformed(M.LOW_SURROGATE if 0xDC00 <= unit < 0xE000 else M.HIGH_SURROGATE) from None


def _lines(text: str, codec: str, first: int) -> list[Line]:
    out, at = [], first
    plain = text.isascii() and codec == "utf-8"
    for found in _LINE.finditer(text):
        if found.end() == found.start():
            break
        size = found.end() - found.start() if plain else len(found.group().encode(codec))
        out.append(Line(len(out) + 1, found.group(1), at, at + size))
        at += size
    return out


def read_source(content: bytes, form: str) -> Source:
    """Decodes strictly by the byte order mark; without one it is UTF-8. WebVTT must be UTF-8."""
    for mark, encoding, codec, name in _BOMS:
        if content.startswith(mark):
            if form == "webvtt":
                raise Malformed(M.VTT_ENCODING.format(name))
            return Source(encoding, _lines(_utf16(content[2:], codec), codec, 2))
    marked = content.startswith(b"\xef\xbb\xbf")
    try:
        text = content[3 if marked else 0 :].decode("utf-8")
    except UnicodeDecodeError:
        raise Malformed(M.BAD_UTF8) from None
    return Source("utf-8-bom" if marked else "utf-8", _lines(text, "utf-8", 3 if marked else 0))
