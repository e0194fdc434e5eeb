"""What commands print in queries lies in files: the driver holds none of it."""

import io
import json

import pytest
from pyspark.sql import functions as F

from cuespark import output as O
from cuespark.plans import marked_queries
from cuespark.plans.marked_queries import QUERIES
from cuespark.plans.tree_queries import digest_now

TEXTS = ["the end", "a feed, \"the\" {feed},{x}", "nothing", "Café ‎ the"]


@pytest.fixture
def directory(spark, tmp_path):
    rows = [(i, f"d/{'ab'[i % 2]}.srt", f"c{i}", i, 1000 * i, 1000 * i + 500, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "row_id bigint, path string, cue_id string, ordinal int, start_ms bigint, end_ms bigint, display_text string").write.parquet(f"{tmp_path}/cues.parquet")
    return str(tmp_path)


def test_lines_are_read_from_a_file(spark, directory):
    got = QUERIES["cli_lines"](spark, directory)
    assert got.inputFiles()
    assert sorted(r.line for r in got.collect()) == [
        "MATCH d/a.srt  00:00:00.000 --> 00:00:00.500  the end  phrases=the ",
        "MATCH d/b.srt  00:00:01.000 --> 00:00:01.500  a feed, \"the\" {feed},{x}  phrases=the ,FEED",
        "MATCH d/b.srt  00:00:03.000 --> 00:00:03.500  Café � the  phrases=the ,café",
        "SUMMARY cues=3 files=2 scanned=2 issues=0",
    ]


def test_matches_are_read_from_a_file(spark, directory):
    got = QUERIES["cli_search"](spark, directory)
    assert got.inputFiles()
    assert sorted(map(tuple, got.collect())) == [("d/a.srt", 0, 500, "the "), ("d/b.srt", 1000, 1500, "the |FEED"), ("d/b.srt", 3000, 3500, "the |café")]


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_records_are_told_one_by_one(piece):
    records = [{"path": 'a"},{"b', "n": [1, 2]}, {"path": "]", "n": []}, 12, "x"]
    for matches in (records, []):
        document = {"status": "ok", "summary": {"cues": 3}, "matches": matches, "issues": [{"path": "c"}], "last": 17}
        told = []
        head = O.read_json(io.StringIO(O.to_json(document)), "matches", told.append, piece)
        assert head == {k: v for k, v in document.items() if k != "matches"}
        assert list(map(json.loads, told)) == matches
    for wrong, fault in (('{"a":1', ValueError), ('{"a" 1}', ValueError), ('{"matches":[1 2]}', ValueError), ('{"a":1}', KeyError)):
        with pytest.raises(fault):
            O.read_json(io.StringIO(wrong), "matches", told.append, piece)


def test_a_dry_run_holds_no_matches(spark, directory, monkeypatch):
    monkeypatch.setattr(marked_queries, "_run", None)  # which parses a document as a whole
    assert [tuple(r) for r in QUERIES["cli_dry_run"](spark, directory).collect()] == [(True, 3, 2, 2, True)]


def test_a_changed_file_has_another_digest(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(b"1")
    paths = spark.createDataFrame([("a.srt",)], "path string")
    digests = paths.select(digest_now(str(tmp_path), F.col("path")).alias("now"))
    first = digests.first().now
    (tmp_path / "a.srt").write_bytes(b"2")
    assert digests.first().now != first
