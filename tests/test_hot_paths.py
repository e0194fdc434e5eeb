"""Operators on one key, path or list that is far larger than the others: the ways beyond a window or an automaton give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuespark.operators import ranking, render, search
from cuespark.operators.plan import cumulative_progress, retained_numbers
from cuespark.operators.ranking import number_in, running_totals
from cuespark.operators.render import render_files
from cuespark.operators.search import search_table


def cues(spark, n=500):
    rng = random.Random(4)
    rows = [("hot/a.srt" if rng.random() < 0.8 else rng.choice(["b.vtt", "c", None]), i, i * 100, i * 100 + 50, f"text {i} {rng.choice(['ab', 'ß', '🎬'])}") for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "path string, ordinal int, start_ms bigint, end_ms bigint, text string")


def test_positions_in_a_crowded_key(spark):
    rows, table = cues(spark)
    own = {}
    want = sorted((str(p), o, own.setdefault(p, []).append(o) or len(own[p])) for p, o, *_ in sorted(rows, key=lambda r: r[1]))
    for crowd in (10**6, 5):
        got = sorted((str(r.path), r.ordinal, r.n) for r in number_in(table, "path", ["ordinal"], "n", crowd).collect())
        assert got == want
    assert number_in(table.limit(0), "path", ["ordinal"], "n").collect() == []


def test_a_long_path_continues_in_further_files(spark, monkeypatch):
    rows, table = cues(spark)
    table = table.where("path is not null")
    whole = {r.path: r.body for r in render_files(table, "webvtt", "text").collect()}
    monkeypatch.setattr(render, "VOLUME", 100)
    monkeypatch.setattr(ranking, "CROWD", 50)
    parts = {r.path: r.body for r in render_files(table, "webvtt", "text").collect()}
    assert {"hot/a.srt", "hot/a.1.srt", "hot/a.2.srt", "hot/a.3.srt", "b.vtt", "c"} <= set(parts)
    head = "WEBVTT\n\n"
    assert whole["hot/a.srt"] == head + "".join(parts[p].removeprefix(head) for p in sorted(parts, key=lambda p: (p.count("."), p)) if p.startswith("hot/a"))
    srt = {r.path: r.body for r in render_files(table, "srt", "text").collect()}
    assert srt["hot/a.1.srt"].startswith("1\n")


def test_retained_numbers_of_a_crowded_path(spark, monkeypatch):
    rows, table = cues(spark)
    table = table.where("path is not null").withColumn("cue_id", F.concat(F.lit("c"), F.col("ordinal")))
    gone = table.where("ordinal % 3 = 0")
    before = sorted(map(tuple, retained_numbers(table, gone).collect()))
    monkeypatch.setattr(ranking, "CROWD", 5)
    assert before and sorted(map(tuple, retained_numbers(table, gone).collect())) == before


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, f"p{i}", rng.choice([0, 3, None])) for i in range(300)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "position int, path string, deleted_cues int").repartition(5)
    total, want = 0, []
    for k, (_, path, n) in enumerate(sorted(rows), 1):
        total += n or 0
        want.append((path, k, total))
    assert sorted(map(tuple, cumulative_progress(table).collect())) == sorted(want)
    assert running_totals(table.limit(0), [F.col("position")], {"n": F.lit(1)}).collect() == []


@pytest.mark.parametrize("few,most", [(64, 10**6), (0, 10**6), (0, 0)])
def test_phrase_tables_of_any_size(spark, monkeypatch, few, most):
    monkeypatch.setattr(search, "FEW", few)
    monkeypatch.setattr(search, "MOST_SENT", most)
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab ß🎬", k=rng.randrange(60))) for _ in range(300)] + [None, ""]
    phrases = [(i, "".join(rng.choices("ab ß🎬", k=rng.randrange(1, 14)))) for i in range(60)] + [(100, "ab"), (101, "ab"), (102, None), (103, "")]
    found = search_table(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, search_text string"),
        spark.createDataFrame(phrases, "query_index int, normalized string"), ["row_id"],
    )
    want = {i: sorted(k for k, p in phrases if p and p in t) for i, t in enumerate(texts) if t}
    assert {r.row_id: r.query_indexes for r in found.collect()} == {i: k for i, k in want.items() if k}
    assert search_table(found.select("row_id", F.lit("x").alias("search_text")), spark.createDataFrame([], "query_index int, normalized string"), ["row_id"]).collect() == []
