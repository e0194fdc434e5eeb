"""Column functions against the kernels, and search with few and many phrases."""

import pytest
from pyspark.sql import functions as F

from cuespark import functions as C
from cuespark.kernel import texts
from cuespark.kernel.files import safe_relative
from cuespark.kernel.formats import detect_format, format_clock, parse_clock
from cuespark.kernel.source import Malformed
from cuespark.operators.parse import cues_of, issues_of, parse_files
from cuespark.operators.ranking import global_rank
from cuespark.operators.search import dedupe_phrases, distinct_phrases, editor_filter, load_phrases, page, preview, search_any, search_one, search_table
from cuespark.shared import checkpointed
from cuespark.sources.tree import write_tree
from cuespark.streaming import windowed_counts

STRINGS = ["", " ", "a", "A\tb", "Straße", "é", "a\x85b\u3000", "<b>x</b>&amp;", "{\\i1}a\\N", "12", " 12\t", "1２", "x\ny\r\nz\r", "\n", "it's", "a/b.SRT", "../x.srt", "/x.vtt", "a//b.ass", ".", "a.ssa", "NOTE x", "note", "NOTES", "STYLE", "REGION ", "\u202e\x9b\x7f", "\u2028"]
CLOCKS = ["00:00:01,5", "1:02:03.04", "00:01.000", "00:60:00,0", "2562047:47:16,854", "2562047:47:16,855", "99999999999999999999:00:00,0", "x", "", "00:00:01", " 00:00:01,123 "]


@pytest.fixture
def strings(spark):
    return spark.createDataFrame([(s,) for s in [*STRINGS, None]], "s string")


def check(table, column, expected):
    for r in table.select("s", column.alias("got")).collect():
        assert r.got == (None if r.s is None else expected(r.s)), (r.s, r.got)


def test_text_functions(strings):
    s = F.col("s")
    check(strings, C.normalize_search("s"), texts.normalize_search)
    check(strings, C.normalize_display("s"), texts.normalize_display)
    check(strings, C.visible_markup("s"), lambda t: texts.visible_markup(t, False))
    check(strings, C.visible_ass("s"), texts.visible_ass)
    check(strings, C.white_collapse(s), texts.collapse)
    check(strings, C.is_blank(s), lambda t: texts.trim(t) == "")
    check(strings, C.is_digits(s), lambda t: t.isascii() and t.isdigit())
    check(strings, C.numeric_token(s), lambda t: t.strip(" \t") if t.strip(" \t").isascii() and t.strip(" \t").isdigit() else None)
    check(strings, C.detect_format(s), detect_format)
    check(strings, C.shell_quote(s), lambda t: "'" + t.replace("'", "'\\''") + "'")
    check(strings, C.vtt_metadata(s), lambda t: t in ("NOTE x", "note", "STYLE", "REGION "))
    check(strings, C.sanitize(s), lambda t: "".join("�" if ord(c) < 32 or 127 <= ord(c) < 160 or c in "\u202e\u2028" else c for c in t))
    assert [r.got for r in strings.where("s is not null").select(C.safe_relative(s).alias("got")).collect()] == [safe_relative(t) for t in STRINGS]


def test_lines(strings):
    lines = {"": [], "x\ny\r\nz\r": ["x", "y", "z"], "\n": [""], "\u2028": ["\u2028"], "a\x85b\u3000": ["a\x85b\u3000"]}
    for r in strings.select("s", C.line_array(F.col("s")).alias("got")).collect():
        if r.s in lines:
            assert r.got == lines[r.s]


def test_clocks(spark):
    table = spark.createDataFrame([(c,) for c in CLOCKS], "s string")

    def kernel(short):
        def parse(text):
            try:
                return parse_clock(text, ",.", short)
            except Malformed:
                return None

        return parse

    check(table, C.parse_clock(F.col("s"), ",."), kernel(False))
    check(table, C.parse_clock(F.col("s"), ",.", True), kernel(True))
    times = spark.createDataFrame([(x,) for x in (-1, 0, 1, 359_999_999, 360_000_000, 9_223_372_036_854, None)], "s bigint")
    check(times, C.format_timestamp(F.col("s")), format_clock)


def test_bytes_and_json(spark):
    table = spark.createDataFrame([(bytearray(b),) for b in (b"\xff\xfea", b"\xfe\xff", b"\xef\xbb\xbfx", b"x", b"")], "b binary")
    assert [r[0] for r in table.select(C.byte_order_mark(F.col("b"))).collect()] == ["utf-16le-bom", "utf-16be-bom", "utf-8-bom", "utf-8", "utf-8"]
    one = spark.createDataFrame([("a\u202e\x9b\u2028\x7f",)], "s string")
    assert one.select(C.escape_json(F.to_json(F.struct("s")))).first()[0] == '{"s":"a\\u202e\\u009b\\u2028\\u007f"}'
    assert one.select(C.cue_id(F.lit("srt"), F.lit(1), F.lit(2), F.lit(0)), C.content_digest(F.lit(b""))).first()[0] == "srt:1:2:0"


def test_parse_files(spark):
    good = b"1\n00:00:01,000 --> 00:00:02,000\na\n"
    rows = [("a.srt", good), ("b.txt", good), ("c.vtt", b"x"), (None, good), ("d.srt", None), ("e.ASS", b"")]
    files = spark.createDataFrame([(p, c and bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    parsed = parse_files(files).cache()
    assert [tuple(r) for r in cues_of(parsed).select("path", "cue_id").collect()] == [("a.srt", "srt:0:34:0")]
    assert sorted((r.path or "", r.error) for r in issues_of(parsed).collect()) == [
        ("", ": unsupported subtitle format"), ("b.txt", "b.txt: unsupported subtitle format"), ("c.vtt", "c.vtt:1: invalid WebVTT header"), ("d.srt", "d.srt: file has no content"),
    ]


@pytest.fixture
def cues(spark):
    rows = [("a", 0, "the strasse is long"), ("a", 1, "nothing"), ("b", 0, "the end, the end"), ("b", 1, None), ("b", 2, "[.*] 100%")]
    return spark.createDataFrame(rows, "path string, ordinal int, search_text string")


def test_search(cues):
    def found(phrases):
        return [(r.path, r.ordinal, r.query_indexes, r.matched_phrases) for r in search_any(cues, phrases).orderBy("path", "ordinal").collect()]

    assert found(["THE", "Straße", " the ", "", "[.*]"]) == [("a", 0, [0, 1], ["THE", "Straße"]), ("b", 0, [0], ["THE"]), ("b", 2, [2], ["[.*]"])]
    assert found([]) == found([" ", ""]) == [] and found(["100%"])[0][1] == 2 and found(["_"]) == []
    many = [f"x{i}" for i in range(100)] + ["the", "strasse"]
    assert found(many) == [("a", 0, [100, 101], ["the", "strasse"]), ("b", 0, [100], ["the"])]
    assert search_one(cues, "THE").count() == 2 and search_one(cues, " ").count() == 0
    assert editor_filter(cues, " ").count() == 5
    assert distinct_phrases(["A", "a ", "b"]).spellings == ["A", "b"]
    assert [(r.path, r.ordinal) for r in preview(cues, 1).orderBy("path").collect()] == [("a", 0), ("b", 0)]


def test_phrase_tables(spark, cues):
    phrases = dedupe_phrases(spark.createDataFrame([(5, "THE"), (7, "the"), (9, " "), (11, "End"), (12, None)], "i int, q string"), "i", "q")
    assert [tuple(r) for r in phrases.orderBy("query_index").collect()] == [(0, "THE", "the"), (1, "End", "end")]
    assert sorted(tuple(r) for r in search_table(cues, phrases, ["path", "ordinal"]).collect()) == [("a", 0, [0]), ("b", 0, [0, 1])]


def test_trees_are_written_safely(spark, tmp_path):
    files = spark.createDataFrame([("a/b.srt", bytearray(b"x"))], "path string, content binary")
    assert write_tree(files, str(tmp_path)) == 1 and (tmp_path / "a/b.srt").read_bytes() == b"x"
    with pytest.raises(Exception, match="can't write"):
        write_tree(spark.createDataFrame([("../b.srt", bytearray(b"x"))], "path string, content binary"), str(tmp_path))


def test_checkpoints_cut_the_lineage(spark):
    kept = checkpointed(spark.range(5).withColumn("x", F.col("id") * 2))
    assert kept.count() == 5 and "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_windows_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2030-01-01 00:00:10"), ("a", "2030-01-01 00:00:50"), ("b", "2030-01-01 00:05:00")], "kind string, at string").selectExpr("kind", "timestamp(at) as at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, at timestamp").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "at", "1 minute", "1 minute", "kind").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.kind, r.rows) for r in spark.table("counted").collect()) == [("a", 2), ("b", 1)]


def test_phrase_files_and_pages(spark, cues, tmp_path):
    (tmp_path / "phrases.txt").write_bytes("Thanks\r\n\nthanks \n  \nMerci à tous\n".encode())
    got = load_phrases(spark, str(tmp_path / "phrases.txt")).orderBy("query_index").collect()
    assert [tuple(r) for r in got] == [(0, "Thanks", "thanks"), (1, "Merci à tous", "merci à tous")]
    assert [r.ordinal for r in page(cues.where("path = 'b'"), 1, 2).collect()] == [2]


def test_ranks_over_all_rows(spark):
    table = spark.range(1000).withColumn("x", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(7)
    assert sorted((r.x, r.rank) for r in global_rank(table, [F.col("x")], "rank").collect()) == [(i, i + 1) for i in range(1000)]
    assert global_rank(table.limit(0), [F.col("x")], "rank").count() == 0
