"""Kernels without Spark: text forms, formats, deletion."""

import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuespark.kernel import messages as M
from cuespark.kernel.formats import detect_format, format_clock, parse, parse_clock, search
from cuespark.kernel.rewrite import delete_cues, splice, validate_deletion
from cuespark.kernel.source import Malformed
from cuespark.kernel.texts import normalize_display, normalize_search, unescape, visible_ass, visible_markup

F1 = b"1\n00:00:01,000 --> 00:00:02,000\nalpha beta\n\n2\n00:00:03,000 --> 00:00:04,000\ngamma\n"
F2 = "7\r\n00:00:00,000 --> 00:00:01,000\r\nNaïve 🎬\r\n\r\n9\r\n00:00:02,000 --> 00:00:03,000\r\nomit\r\n"
F3 = b"WEBVTT demo\n\nNOTE made by hand\nignored\n\nintro\n00:01.000 --> 00:02.500 line:90%\n<v Ann><b>Hi</b> &amp; bye</v>\n\n00:00:03.000 --> 00:00:04.000\nlast\n"
F4 = (
    b"[Events]\nFormat: Layer, End, Start, Text\nComment: 0,0:00:02.00,0:00:01.00,skip\n"
    b"Dialogue: 0,0:00:02.50,0:00:01.25,{\\i1}One\\Ntwo, three{\\i0}\nDialogue: 0,0:00:04.00,0:00:03.00,{\\p1}m 0 0{\\p0}seen\\hhere\n"
)


@pytest.mark.parametrize(
    "path,form", [("a.srt", "srt"), ("A.SRT", "srt"), ("x/y.Vtt", "webvtt"), ("b.ass", "ass"), ("b.ssa", None), ("b", None), (".srt", "srt"), ("d.srt/b", None), ("a.srt.txt", None)]
)
def test_format_is_that_of_the_last_extension(path, form):
    assert detect_format(path) == form


@pytest.mark.parametrize(
    "text,form",
    [(" A\tB\n", "a b"), ("Straße", "strasse"), ("Cafe\u0301", "café"), ("\u2003\u00a0", ""), ("[.*]", "[.*]"), ("a\x1cb", "a\x1cb"), ("a\x85b", "a b"), ("İ", "i\u0307"), ("", "")],
)
def test_search_form(text, form):
    assert normalize_search(text) == form


def test_search_form_is_stable_for_every_character():
    for point in range(sys.maxunicode + 1):
        if not 0xD800 <= point < 0xE000:
            once = normalize_search(f"a{chr(point)}b")
            assert normalize_search(once) == once


@given(st.text())
def test_display_form_is_stable(text):
    assert normalize_display(normalize_display(text)) == normalize_display(text)


@pytest.mark.parametrize(
    "text,times,shown",
    [
        ("<b>Hi</b> &amp; <i>x</i>", False, "Hi & x"), ("2 < 3 > 1", False, "2 < 3 > 1"), ("<x>y</x>", False, "<x>y</x>"), ("a<br>b<BR/>c", False, "a b c"),
        ("<c.a.b>k</c>", False, "k"), ("<c.>k", False, "<c.>k"), ("<b:x>k", False, "<b:x>k"), ("<b.x>k", False, "<b.x>k"), ("<b", False, "<b"), ("<not <b>", False, "<not <b>"),
        ("< / b >x", False, "x"), ("<font color=red>x</font>", False, "x"), ("<v Ann>x", True, "x"), ("<00:01.000>x", True, "x"), ("<00:01.000>x", False, "<00:01.000>x"),
        ("<1:00:01.000>x", True, "<1:00:01.000>x"), ("<100:00:01.000>x", True, "x"), ("<00:01,000>x", True, "<00:01,000>x"), ("< 00:01.000>x", True, "< 00:01.000>x"),
        ("&lt;b&gt;", False, "<b>"), ("&#65;&#x42;&#0;&#xD800;&#1;&#x80;", False, "AB��\x01€"), ("&nosuch;", False, "&nosuch;"), ("x &amp", False, "x &"),
    ],
)
def test_visible_markup(text, times, shown):
    assert visible_markup(text, times) == shown


@pytest.mark.parametrize(
    "text,shown",
    [
        ("{\\i1}a{\\i0}b", "ab"), ("a\\Nb\\nc\\hd", "a b c d"), ("{\\p1}m 0 0{\\p0}x", "x"), ("{\\P 2}m\\Nn", ""), ("a{b", "a{b"), ("{x}a{b\\Nc", "a{b c"),
        ("{\\p1}x{\\p0\\p1}y{\\p0}z", "z"), ("}{", "}{"), ("", ""), ("\\q", "\\q"),
    ],
)
def test_visible_ass(text, shown):
    assert visible_ass(text) == shown


def test_unclosed_delimiters_are_linear():
    assert visible_markup("<" * (1 << 20), True) == "<" * (1 << 20)
    assert visible_ass("{" * (1 << 20)) == "{" * (1 << 20)
    assert unescape("&" * 100_000) == "&" * 100_000


@pytest.mark.parametrize("text,ms", [("00:00:01,5", 1500), ("1:02:03.04", 3723040), (" 100:00:00,000 ", 360000000), ("2562047:47:16,854", 9223372036854)])
def test_clock(text, ms):
    assert parse_clock(text, ",.") == ms


def test_largest_clock():
    with pytest.raises(Malformed, match="too large"):
        parse_clock("2562047:47:16,855", ",.")


@pytest.mark.parametrize("text", ["00:00:01", "00:00:01,", "00:00:01,1234", "00:0a:01,1", "0:0:01,1", "00:60:01,1", "00:01,1", "1:2:3:4,1", "00:00:٠١,1"])
def test_bad_clock(text):
    with pytest.raises(Malformed):
        parse_clock(text, ",.")


def test_shown_clock():
    assert [format_clock(x) for x in (-5, 0, 3723040, 360000000)] == ["00:00:00.000", "00:00:00.000", "01:02:03.040", "100:00:00.000"]


def test_srt_spans_and_deletion():
    d = parse(F1, "srt")
    assert [(c.cue_id, c.start_ms, c.end_ms, c.display_text, c.index_span) for c in d.cues] == [("srt:0:44:0", 1000, 2000, "alpha beta", (0, 1)), ("srt:44:82:1", 3000, 4000, "gamma", (44, 45))]
    ids = [c.cue_id for c in d.cues]
    assert delete_cues(F1, d, ids[:1]) == b"1\n00:00:03,000 --> 00:00:04,000\ngamma\n"
    assert delete_cues(F1, d, ids) == b""
    assert delete_cues(F1, d, []) == F1
    assert delete_cues(F1, d, [ids[0], ids[0]]) == delete_cues(F1, d, ids[:1])
    with pytest.raises(Malformed, match="unknown cue"):
        delete_cues(F1, d, ["srt:0:44:7"])


@pytest.mark.parametrize("codec,mark,name", [("utf-16-le", b"\xff\xfe", "utf-16le-bom"), ("utf-16-be", b"\xfe\xff", "utf-16be-bom"), ("utf-8", b"\xef\xbb\xbf", "utf-8-bom"), ("utf-8", b"", "utf-8")])
def test_encodings(codec, mark, name):
    content = mark + F2.encode(codec)
    d = parse(content, "srt")
    assert d.source.encoding == name
    assert [c.display_text for c in d.cues] == ["Naïve 🎬", "omit"]
    left = delete_cues(content, d, [d.cues[1].cue_id])
    assert left == mark + F2.split("9\r\n")[0].replace("7", "1", 1).encode(codec)
    assert validate_deletion(content, d, [d.cues[1].cue_id], left) is None
    assert validate_deletion(content, d, [d.cues[1].cue_id], content) is not None
    for c in d.cues:
        assert content[slice(*c.index_span)].decode(codec).isdigit()


def test_webvtt_and_ass():
    assert [(c.cue_id, c.display_text, c.start_ms) for c in parse(F3, "webvtt").cues] == [("webvtt:40:111:0", "Hi & bye", 1000), ("webvtt:111:146:1", "last", 3000)]
    assert [(c.cue_id, c.display_text, c.start_ms) for c in parse(F4, "ass").cues] == [("ass:79:139:0", "One two, three", 1250), ("ass:139:199:1", "seen here", 3000)]


def test_files_without_cues():
    assert parse(b"", "srt").cues == parse(b" \n\n", "srt").cues == parse(b"WEBVTT\n", "webvtt").cues == parse(b"[Events]\nFormat: Start, End, Text\n", "ass").cues == parse(b"", "ass").cues == []


def test_leading_blank_lines_belong_to_the_first_cue():
    content = b"\r\n\n" + F1
    d = parse(content, "srt")
    assert d.cues[0].delete_span[0] == 0
    assert delete_cues(content, d, [d.cues[0].cue_id]) == b"1\n00:00:03,000 --> 00:00:04,000\ngamma\n"


T = b"00:00:01,000 --> 00:00:02,000\n"
ASS = b"[Events]\nFormat: Start, End, Text\n"


@pytest.mark.parametrize(
    "form,content,message,line",
    [
        ("srt", b"x\n" + T + b"a\n", M.SRT_ID, 1), ("srt", b"1\n", M.SRT_NO_TIMING, 1), ("srt", b"1\n\n" + T + b"a", M.SRT_NO_TIMING, 1), ("srt", b"1\nx\na\n", M.SRT_TIMING, 2),
        ("srt", b"1\n" + T + b"\n", M.SRT_EMPTY, 2), ("srt", b"1\n00:61:01,000 --> 00:00:02,000\na\n", 'timestamp field out of range in "00:61:01,000"', 2),
        ("srt", b"1\n00:00:03,000 --> 00:00:02,000\na\n", M.SRT_BACKWARDS, 2), ("srt", b"1\n" + T + b"a\n2\n" + T + b"b\n", M.SRT_RUN_ON, 4),
        ("srt", b"1\n9999999999:00:00,000 --> 9999999999:00:00,001\na\n", 'timestamp "9999999999:00:00,000" is too large', 2),
        ("ass", b"[Events]\nDialogue: 1,2,3\n", M.ASS_EARLY, 2), ("ass", b"[Events]\nFormat: Start, End\n", M.ASS_FIELDS, 2), ("ass", b"[Events]\nFormat: Text, Start, End\n", M.ASS_TEXT_LAST, 2),
        ("ass", ASS + b"Dialogue: 1,2\n", M.ASS_SHORT, 3), ("ass", ASS + b"what\n", M.ASS_RECORD, 3), ("ass", b"[Events]\nFormat: Start, Start, End, Text\n", 'ASS Events Format repeats field "start"', 2),
        ("webvtt", b"", M.VTT_MISSING, 1), ("webvtt", b"WEBVTTX\n", M.VTT_HEADER, 1), ("webvtt", b"WEBVTT\nx\n", M.VTT_HEADER_END, 2), ("webvtt", b"WEBVTT\n\nid\n", M.VTT_BLOCK, 3),
        ("webvtt", b"WEBVTT\n\n00:01.000 --> 00:02.000\n", M.VTT_EMPTY, 3), ("webvtt", b"WEBVTT\n\n00:01.000 --> 00:02.000 --> x\na\n", M.VTT_SEPARATOR, 3),
        ("webvtt", b"WEBVTT\n\n00:01,000 --> 00:02.000\na\n", 'invalid WebVTT start time: timestamp "00:01,000" has no fractional separator', 3),
        ("srt", b"\xff", M.BAD_UTF8, 0), ("srt", b"\xff\xfea", M.ODD_UTF16, 0), ("srt", b"\xff\xfe\x00\xd8a\x00", M.HIGH_SURROGATE, 0), ("srt", b"\xff\xfe\x00\xdc", M.LOW_SURROGATE, 0),
        ("srt", b"\xff\xfe\x00\xd8", M.HIGH_SURROGATE, 0), ("webvtt", b"\xfe\xff", "WebVTT must be UTF-8; UTF-16BE BOM found", 0), ("txt", b"", M.UNSUPPORTED, 0),
    ],
)
def test_malformed(form, content, message, line):
    with pytest.raises(Malformed) as e:
        parse(content, form)
    assert (e.value.message, e.value.line) == (message, line)


def test_phrase_search_in_a_document():
    d = parse(F1, "srt")
    assert [c.ordinal for c in search(d, " ALPHA\tBeta ")] == [0]
    assert search(d, " \u00a0") == []


def test_edits_must_fit():
    assert splice(b"abcdef", [(1, 2, b"X"), (4, 6, b"")]) == b"aXcd"
    for bad in ([(0, 2, b""), (1, 3, b"")], [(2, 9, b"")], [(3, 2, b"")]):
        with pytest.raises(ValueError):
            splice(b"abcdef", bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(0, 10**4), st.text(st.characters(codec="utf-8", exclude_characters="\r\n<>&", exclude_categories=["Z", "C"]), min_size=1)), max_size=8), st.data())
def test_render_parse_delete(cues, data):
    body = "".join(f"{i + 1}\n{format_clock(s, ',')} --> {format_clock(s + n, ',')}\nx{t}\n\n" for i, (s, n, t) in enumerate(cues)).encode()
    d = parse(body, "srt")
    assert [(c.start_ms, c.end_ms) for c in d.cues] == [(s, s + n) for s, n, _ in cues]
    gone = data.draw(st.sets(st.sampled_from([c.cue_id for c in d.cues]))) if d.cues else set()
    left = delete_cues(body, d, gone)
    assert validate_deletion(body, d, gone, left) is None
    assert left == body or gone
