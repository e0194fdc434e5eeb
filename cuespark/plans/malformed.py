"""Contents that can't be parsed: one for each failure, with the line and the message that name it."""

from __future__ import annotations

_T = "00:00:01,000 --> 00:00:02,000"
_V = "00:01.000 --> 00:02.000"
_EVENTS = "[Events]\nFormat: Start, End, Text\n"

# (format, content, line or 0, message)
MALFORMED: list[tuple[str, bytes, int, str]] = [
    ("srt", b"1\n" + _T.encode() + b"\n\xff\n", 0, "malformed UTF-8"),
    ("srt", b"\xff\xfea", 0, "odd-length UTF-16 data"),
    ("srt", b"\xff\xfe\x3d\xd8a\x00", 0, "unpaired high surrogate in UTF-16 data"),
    ("srt", b"\xfe\xff\xdc\x00\x00a", 0, "unpaired low surrogate in UTF-16 data"),
    ("webvtt", "WEBVTT\n".encode("utf-16"), 0, "WebVTT must be UTF-8; UTF-16LE BOM found"),
    ("srt", f"one\n{_T}\nx\n".encode(), 1, "expected a numeric SRT cue ID"),
    ("srt", b"\n\n1\n", 3, "SRT cue is missing a timing line"),
    ("srt", b"1\n00:00:01,000 -> 00:00:02,000\nx\n", 2, "invalid SRT timing line"),
    ("srt", b"1\n00:00:02,000 --> 00:00:01,000\nx\n", 2, "SRT cue ends before it starts"),
    ("srt", f"1\n{_T}\n\n".encode(), 2, "SRT cue has no payload"),
    ("srt", f"1\n{_T}\nx\n2\n{_T}\ny\n".encode(), 4, "SRT cues must be separated by a blank line"),
    ("srt", b"1\n00:00:01 --> 00:00:02,000\nx\n", 2, 'timestamp "00:00:01" has no fractional separator'),
    ("srt", b"1\n00:00:01,0000 --> 00:00:02,000\nx\n", 2, 'invalid timestamp fraction in "00:00:01,0000"'),
    ("srt", b"1\n00:01,000 --> 00:00:02,000\nx\n", 2, 'invalid timestamp "00:01,000"'),
    ("srt", b"1\n00:0:01,000 --> 00:00:02,000\nx\n", 2, 'invalid timestamp field width in "00:0:01,000"'),
    ("srt", b"1\n00:60:01,000 --> 00:00:02,000\nx\n", 2, 'timestamp field out of range in "00:60:01,000"'),
    ("srt", b"1\n99999999999999:00:01,000 --> 00:00:02,000\nx\n", 2, 'timestamp "99999999999999:00:01,000" is too large'),
    ("webvtt", b"", 1, "WebVTT file is missing the WEBVTT header"),
    ("webvtt", b"WEBVTTX\n", 1, "invalid WebVTT header"),
    ("webvtt", f"WEBVTT\n{_V}\nx\n".encode(), 3, "WebVTT header must be followed by a blank line"),
    ("webvtt", b"WEBVTT\n\nx\ny\n", 3, "invalid WebVTT block: expected cue timing"),
    ("webvtt", f"WEBVTT\n\n{_V}\n".encode(), 3, "WebVTT cue has no payload"),
    ("webvtt", f"WEBVTT\n\n{_V} --> x\ny\n".encode(), 3, "invalid WebVTT timing separator"),
    ("webvtt", b"WEBVTT\n\n --> 00:02.000\nx\n", 3, "invalid WebVTT timing line"),
    ("webvtt", b"WEBVTT\n\n00:01 --> 00:02.000\nx\n", 3, 'invalid WebVTT start time: timestamp "00:01" has no fractional separator'),
    ("webvtt", b"WEBVTT\n\n00:01.000 --> 00:99.000\nx\n", 3, 'invalid WebVTT end time: timestamp field out of range in "00:99.000"'),
    ("webvtt", b"WEBVTT\n\n00:02.000 --> 00:01.000\nx\n", 3, "WebVTT cue ends before it starts"),
    ("ass", b"[Events]\nno record\n", 2, "invalid ASS Events record"),
    ("ass", b"[Events]\nDialogue: 0:00:01.00,0:00:02.00,x\n", 2, "ASS Dialogue appears before an Events Format declaration"),
    ("ass", f"{_EVENTS}Dialogue: 0:00:01.00,0:00:02.00\n".encode(), 3, "ASS Dialogue has fewer fields than the active Format"),
    ("ass", f"{_EVENTS}Dialogue: x,0:00:02.00,y\n".encode(), 3, 'invalid ASS start time: timestamp "x" has no fractional separator'),
    ("ass", f"{_EVENTS}Dialogue: 0:00:01.00,0:00:2.00,y\n".encode(), 3, 'invalid ASS end time: invalid timestamp field width in "0:00:2.00"'),
    ("ass", f"{_EVENTS}Dialogue: 0:00:02.00,0:00:01.00,y\n".encode(), 3, "ASS Dialogue ends before it starts"),
    ("ass", b"[Events]\nFormat: Start,,Text\n", 2, "ASS Events Format contains an empty field"),
    ("ass", b"[Events]\nFormat: Start, End, start, Text\n", 2, 'ASS Events Format repeats field "start"'),
    ("ass", b"[Events]\nFormat: Start, Text\n", 2, "ASS Events Format must contain Start, End, and Text"),
    ("ass", b"[Events]\nFormat: Text, Start, End\n", 2, "ASS Events Format Text field must be last"),
]
