"""Texts rendered, read again and parsed as they are, against hand-written results."""

import pytest

from cuespark.plans.reference_queries import QUERIES, documents_parsed

TEXTS = ["“Quoted”, isn’t it?", "cafe\u0301 — 100 %", "a\nb\r\nc", None, "  ", "z\u200bw \ufffd \u200e", "[music] #1: -->"]
SHOWN = ["“Quoted”, isn’t it?", "café — 100 %", "a b c", "", "", "z\u200bw \ufffd \u200e", "[music] #1: -->"]


@pytest.mark.parametrize("name", ["roundtrip_srt", "roundtrip_vtt", "roundtrip_ass", "roundtrip_utf16", "roundtrip_utf16be_ass", "roundtrip_srt_native"])
def test_texts_come_back_as_they_are(spark, tmp_path, name):
    rows = [(i, "a.srt", f"c{i}", i, 1000 * i, 1000 * i + (i % 2), t) for i, t in enumerate(TEXTS)] + [(90, "a.srt", "c90", 90, 5, 4, "back"), (91, "a.srt", "c91", 91, None, 4, "none")]
    spark.createDataFrame(rows, "row_id bigint, path string, cue_id string, ordinal int, start_ms bigint, end_ms bigint, display_text string").write.parquet(f"{tmp_path}/cues.parquet")
    got = sorted((r.ordinal, r.start_ms, r.end_ms, r.display_text, r.search_text) for r in QUERIES[f"whole_{name}"](spark, str(tmp_path)).collect())
    assert got == [(i, 1000 * i, 1000 * i + (i % 2), t, t.casefold()) for i, t in enumerate(SHOWN)]


def test_documents_are_parsed_whole(spark, tmp_path):
    times = "00:00:01,000 --> 00:00:02,000"
    rows = [
        (1, "srt", f"1\n{times}\n<i>Fish &amp; chips</i>\ncafe\u0301<br>&#233;\n\n2\n{times}\nTwo\n"),
        (2, "webvtt", "WEBVTT\n\n00:01.000 --> 00:01.000\n<v Ann>Hey <00:00:01.500><c.loud>you</c>\n"),
        (3, "srt", "1\nno times\nx\n"), (4, "text", "not a subtitle file"), (5, "srt", None), (6, "webvtt", "WEBVTT\n"),
    ]
    spark.createDataFrame(rows, "doc_id bigint, format string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in documents_parsed(spark, str(tmp_path)).orderBy("doc_id", "ordinal").collect()]
    assert got == [
        (1, "srt", 0, 1000, 2000, "Fish & chips café é", "fish & chips café é", None, None),
        (1, "srt", 1, 1000, 2000, "Two", "two", None, None),
        (2, "webvtt", 0, 1000, 1000, "Hey you", "hey you", None, None),
        (3, "srt", None, None, None, None, None, 2, "3:2: invalid SRT timing line"),
        (5, "srt", None, None, None, None, None, None, "5: file has no content"),
        (6, "webvtt", None, None, None, None, None, None, None),
    ]
