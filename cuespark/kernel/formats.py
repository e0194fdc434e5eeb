"""SRT, WebVTT and ASS parsers: a file gives all of its cues, or the first failure."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from cuespark.kernel import messages as M
from cuespark.kernel.source import Line, Malformed, Source, read_source
from cuespark.kernel.texts import WHITE, cue_text, trim, visible_ass, visible_markup

FORMATS = {".srt": "srt", ".ass": "ass", ".vtt": "webvtt"}
MOST_MS = (2**63 - 1) // 1_000_000  # a time must fit into nanoseconds of 64 bits

_NUMBER = re.compile(r"[ \t]*([0-9]+)[ \t]*")
_SRT_TIMING = re.compile(r"[\t\n\f\r ]*([^\t\n\f\r ]+)[\t\n\f\r ]*-->[\t\n\f\r ]*([^\t\n\f\r ]+)(?:[\t\n\f\r ]+.*)?", re.DOTALL)
_DIGITS = re.compile(r"[0-9]+")
_FIELDS = re.compile(f"[^{WHITE}]+")


@dataclass(frozen=True)
class Cue:
    """A cue; spans are half-open byte ranges of the file. ``index_span`` is the number's token (SRT only)."""

    ordinal: int
    cue_id: str
    start_ms: int
    end_ms: int
    display_text: str
    search_text: str
    delete_span: tuple[int, int]
    index_span: tuple[int, int] | None = None


@dataclass(frozen=True)
class Document:
    form: str
    source: Source
    cues: list[Cue]


def detect_format(path: str) -> str | None:
    """The format by the last extension of the last component, in any letter case; null if there is none."""
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return FORMATS.get(name[dot:].lower()) if dot >= 0 else None


def parse_clock(value: str, separators: str, short: bool = False) -> int:
    """Milliseconds of ``[H+:]MM:SS<separator>f{1,3}``; hours may only be missing if ``short``."""
    value = trim(value)
    shown = json.dumps(value, ensure_ascii=False)
    cut = max(value.rfind(s) for s in separators)
    if cut < 0:
        raise Malformed(M.CLOCK_SEPARATOR.format(shown))
    fraction, parts = value[cut + 1 :], value[:cut].split(":")
    if len(fraction) > 3 or not _DIGITS.fullmatch(fraction):
        raise Malformed(M.CLOCK_FRACTION.format(shown))
    if len(parts) == 2 and short:
        parts.insert(0, "0")
    if len(parts) != 3 or not all(map(_DIGITS.fullmatch, parts)):
        raise Malformed(M.CLOCK.format(shown))
    hours, minutes, seconds = parts
    if len(minutes) != 2 or len(seconds) != 2:
        raise Malformed(M.CLOCK_WIDTH.format(shown))
    if len(hours.lstrip("0")) > 20:
        raise Malformed(M.CLOCK_SIZE.format(shown))
    if minutes > "59" or seconds > "59":
        raise Malformed(M.CLOCK_RANGE.format(shown))
    total = ((int(hours) * 60 + int(minutes)) * 60 + int(seconds)) * 1000 + int(fraction.ljust(3, "0"))
    if total > MOST_MS:
        raise Malformed(M.CLOCK_SIZE.format(shown))
    return total


def format_clock(ms: int, separator: str = ".") -> str:
    ms = max(0, ms)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}{separator}{ms % 1000:03d}"


def blocks(lines: list[Line]) -> Iterator[tuple[list[Line], int]]:
    """The groups of lines between blank ones, each with the offset where the next group, or the file, begins or ends."""
    groups = [list(g) for blank, g in groupby(lines, key=lambda x: x.blank) if not blank]
    ends = [g[0].start for g in groups[1:]] + ([lines[-1].next] if lines else [])
    return zip(groups, ends)


def _srt(source: Source) -> Iterator[tuple]:
    begin = source.lines[0].start if source.lines else 0
    for block, end in blocks(source.lines):
        head = block[0]
        number = _NUMBER.fullmatch(head.text)
        if not number:
            raise Malformed(M.SRT_ID, head.number)
        if len(block) < 2:
            raise Malformed(M.SRT_NO_TIMING, head.number)
        timing = _SRT_TIMING.fullmatch(block[1].text)
        if not timing:
            raise Malformed(M.SRT_TIMING, block[1].number)
        try:
            times = [parse_clock(x, ",.") for x in timing.groups()]
        except Malformed as e:
            raise Malformed(e.message, block[1].number) from None
        if times[1] < times[0]:
            raise Malformed(M.SRT_BACKWARDS, block[1].number)
        if len(block) < 3:
            raise Malformed(M.SRT_EMPTY, block[1].number)
        for one, two in zip(block[2:], block[3:]):
            if _NUMBER.fullmatch(one.text) and _SRT_TIMING.fullmatch(two.text):
                raise Malformed(M.SRT_RUN_ON, one.number)
        token = tuple(head.start + source.width * at for at in number.span(1))
        # the first cue owns the blank lines before it, every cue those after it
        yield times, visible_markup("\n".join(x.text for x in block[2:]), False), (begin, end), token
        begin = end


def _vtt_times(text: str) -> list[int]:
    sides = text.split("-->")
    if len(sides) != 2:
        raise Malformed(M.VTT_SEPARATOR)
    left, right = trim(sides[0]), _FIELDS.search(sides[1])
    if not left or not right:
        raise Malformed(M.VTT_TIMING)
    times = []
    for value, message in ((left, M.VTT_START), (right.group(), M.VTT_END)):
        try:
            times.append(parse_clock(value, ".", True))
        except Malformed as e:
            raise Malformed(message.format(e.message)) from None
    if times[1] < times[0]:
        raise Malformed(M.VTT_BACKWARDS)
    return times


_VTT_OTHER = re.compile(r"NOTE(?:[ \t].*)?|STYLE|REGION", re.DOTALL)


def _vtt(source: Source) -> Iterator[tuple]:
    lines = source.lines
    if not lines:
        raise Malformed(M.VTT_MISSING, 1)
    if not re.match(r"WEBVTT(?:[ \t]|\Z)", lines[0].text):
        raise Malformed(M.VTT_HEADER, lines[0].number)
    body = next((i for i, x in enumerate(lines) if i and x.blank), None)
    if body is None:
        if len(lines) > 1:
            raise Malformed(M.VTT_HEADER_END, lines[-1].number)
        return
    for block, end in blocks(lines[body:]):
        if _VTT_OTHER.fullmatch(trim(block[0].text).upper()):
            continue
        at = 0 if "-->" in block[0].text else 1
        if at >= len(block) or "-->" not in block[at].text:
            raise Malformed(M.VTT_BLOCK, block[0].number)
        if at + 1 == len(block):
            raise Malformed(M.VTT_EMPTY, block[at].number)
        try:
            times = _vtt_times(block[at].text)
        except Malformed as e:
            raise Malformed(e.message, block[at].number) from None
        yield times, visible_markup("\n".join(x.text for x in block[at + 1 :]), True), (block[0].start, end), None


def _ass_fields(value: str) -> list[str]:
    names = [trim(x).lower() for x in value.split(",")]
    for i, name in enumerate(names):
        if not name:
            raise Malformed(M.ASS_EMPTY_FIELD)
        if name in names[:i]:
            raise Malformed(M.ASS_REPEATED.format(json.dumps(name, ensure_ascii=False)))
    if not {"start", "end", "text"} <= set(names):
        raise Malformed(M.ASS_FIELDS)
    if names[-1] != "text":
        raise Malformed(M.ASS_TEXT_LAST)
    return names


def _ass_times(record: dict[str, str]) -> list[int]:
    times = []
    for name, message in (("start", M.ASS_START), ("end", M.ASS_END)):
        try:
            times.append(parse_clock(record[name], "."))
        except Malformed as e:
            raise Malformed(message.format(e.message)) from None
    if times[1] < times[0]:
        raise Malformed(M.ASS_BACKWARDS)
    return times


def _ass(source: Source) -> Iterator[tuple]:
    events, names = False, None
    for line in source.lines:
        bare = trim(line.text)
        if len(bare) > 1 and bare[0] == "[" and bare[-1] == "]":
            events = trim(bare[1:-1]).casefold() == "events"
            names = None
            continue
        if not events or not bare or bare[0] == ";":
            continue
        key, colon, value = line.text.partition(":")
        kind = trim(key).casefold()
        try:
            if not colon:
                raise Malformed(M.ASS_RECORD)
            if kind == "format":
                names = _ass_fields(value)
            elif kind == "dialogue":
                if names is None:
                    raise Malformed(M.ASS_EARLY)
                fields = value.split(",", len(names) - 1)
                if len(fields) < len(names):
                    raise Malformed(M.ASS_SHORT)
                record = dict(zip(names, fields))
                yield _ass_times(record), visible_ass(record["text"]), (line.start, line.next), None
        except Malformed as e:
            raise Malformed(e.message, line.number) from None


_PARSERS = {"srt": _srt, "webvtt": _vtt, "ass": _ass}


def parse(content: bytes, form: str) -> Document:
    """All cues of a file, in source order; raises ``Malformed`` with the first failure."""
    if form not in _PARSERS:
        raise Malformed(M.UNSUPPORTED)
    source = read_source(content, form)
    cues = []
    for times, visible, span, token in _PARSERS[form](source):
        n = len(cues)
        cues.append(Cue(n, f"{form}:{span[0]}:{span[1]}:{n}", *times, *cue_text(visible), span, token))
    return Document(form, source, cues)


def search(document: Document, phrase: str) -> list[Cue]:
    """The cues whose search text holds the phrase, normalized; a phrase without text matches nothing."""
    from cuespark.kernel.texts import normalize_search

    wanted = normalize_search(phrase)
    return [c for c in document.cues if wanted in c.search_text] if wanted else []
