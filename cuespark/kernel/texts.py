"""Text semantics: white space, normal forms, and visible text of markup."""

from __future__ import annotations

import html
import re
import unicodedata

# The characters that count as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{WHITE}]+")

# The tags that are no visible text; the last one stands for a blank.
TAGS = ("b", "i", "u", "s", "strike", "strong", "em", "font", "span", "c", "v", "lang", "ruby", "rt", "br")

_TAG = re.compile(r"<([^>]*)>")
_NAMED = re.compile(rf"/?[{WHITE}]*(?P<name>{'|'.join(TAGS)})(?:(?P<classes>(?:\.[^. \t\r\n<>]+)+)|(?:[ \t][^<>]*)?)", re.IGNORECASE | re.DOTALL)
_CUE_TIME = re.compile(r"(?:[0-9]{2,}:)?[0-5][0-9]:[0-5][0-9]\.[0-9]{3}")
_ENTITY = re.compile(r"&(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|[^\t\n\f <&#;]{1,32};?)")
_DRAWING = re.compile(r"\\p\s*([0-9]+)", re.IGNORECASE | re.ASCII)
_ASS_PIECE = re.compile(r"\{([^}]*)\}|\\[Nnh]")
_ASS_BLANK = re.compile(r"\\[Nnh]")


def trim(text: str) -> str:
    return text.strip(WHITE)


def collapse(text: str) -> str:
    """Runs of white space as one blank, none at the edges."""
    return _RUNS.sub(" ", text).strip(" ")


def normalize_display(text: str) -> str:
    """Composed form with single blanks."""
    return collapse(text) if text.isascii() else collapse(unicodedata.normalize("NFC", text))


def normalize_search(text: str) -> str:
    """The form in which phrases are compared: composed, fully case-folded, single blanks. Idempotent."""
    if text.isascii():
        return collapse(text.lower())
    folded = unicodedata.normalize("NFC", text).casefold()
    return collapse(unicodedata.normalize("NFC", folded))


def _entity(found: re.Match) -> str:
    decimal, hexadecimal = found.group(1), found.group(2)
    if decimal is None and hexadecimal is None:
        return html.unescape(found.group())
    number = int(decimal) if decimal else int(hexadecimal, 16)
    if number == 0 or number > 0x10FFFF or 0xD800 <= number < 0xE000:
        return "\ufffd"
    if 0x80 <= number < 0xA0:
        # the numbers of this range mean the characters of that code page
        return bytes([number]).decode("cp1252", "ignore") or chr(number)
    return chr(number)


def unescape(text: str) -> str:
    """Character references replaced; numeric ones keep control characters and non-characters."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


def tag_effect(content: str, timestamps: bool) -> str | None:
    """What a tag with this content stands for: "" or a blank; null if it is visible text."""
    if timestamps and _CUE_TIME.fullmatch(content):
        return ""
    bare = trim(content).removesuffix("/")
    found = _NAMED.fullmatch(trim(bare))
    if not found or (found["classes"] and found["name"].lower() != "c"):
        return None
    return " " if found["name"].lower() == "br" else ""


def visible_markup(text: str, timestamps: bool) -> str:
    """Text without the known tags, references decoded afterwards. Linear: nothing is searched after the last ``>``."""
    last = text.rfind(">") + 1

    def show(found: re.Match) -> str:
        effect = tag_effect(found.group(1), timestamps)
        return found.group() if effect is None else effect

    return unescape(_TAG.sub(show, text[:last]) + text[last:] if last else text)


def visible_ass(text: str) -> str:
    """Text outside of override blocks and drawings, with the escaped breaks and blanks as blanks."""
    last = text.rfind("}") + 1
    out: list[str] = []
    drawing, at = False, 0
    for found in _ASS_PIECE.finditer(text, 0, last):
        if not drawing:
            out.append(text[at : found.start()])
        at = found.end()
        if found.group(1) is None:
            out.append("" if drawing else " ")
        else:
            for level in _DRAWING.findall(found.group(1)):
                drawing = int(level) != 0
    if not drawing:
        # no block can close any more
        out.append(_ASS_BLANK.sub(" ", text[at:]))
    return "".join(out)


def cue_text(visible: str) -> tuple[str, str]:
    """The display and the search form of a cue's visible text."""
    return normalize_display(visible), normalize_search(visible)
