import random

import pytest

from cuespark.llm import runs
from cuespark.llm.runs import collapse_runs

SCHEMA = "path string, cue_id string, ordinal int, start_ms bigint, end_ms bigint, display_text string, n int, v string, count int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def collapse(spark, rows, **named):
    out = collapse_runs(table(spark, rows), "path", "cue_id", "ordinal", "start_ms", "end_ms", "display_text", **named)
    return sorted((r.path, r.first_ordinal, r.last_ordinal, r["count"], r.start_ms, r.end_ms) for r in out.collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def agree(a, b):
    if a is None or b is None:
        return False
    a, b = ("".join(c for c in t.lower() if c.isalnum()) for t in (a, b))
    return [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()] and distance(a, b) * 10 <= max(len(a), len(b))


def brute(rows):
    out = []
    by = {}
    for r in set(rows):
        if r[0] is not None and r[3] is not None and r[4] is not None and r[4] > r[3]:
            by.setdefault(r[0], []).append(r)
    for path, events in by.items():
        events.sort(key=lambda r: (r[3], r[2]))
        runs = [[events[0]]]
        for a, b in zip(events, events[1:]):
            if b[3] - a[4] <= 10_000 and agree(a[5], b[5]):
                runs[-1].append(b)
            else:
                runs.append([b])
        out += [(path, r[0][2], r[-1][2], len(r), r[0][3], max(x[4] for x in r)) for r in runs]
    return sorted(out)


@pytest.mark.parametrize("crowd,sent", [(runs.CROWD, runs.MOST_SENT), (5, runs.MOST_SENT), (5, 0)])
def test_against_brute_force(spark, monkeypatch, crowd, sent):
    monkeypatch.setattr(runs, "CROWD", crowd)
    monkeypatch.setattr(runs, "MOST_SENT", sent)
    rng = random.Random(3)
    texts = ["Hello there, my friend", "hello there my fiend!", "Hello there, my friend 2", "♪", "…", None, "x", "y", "über die alte Brücke gehen", "ueber die alte Brücke gehen", "Ünter die alte Brücke gehen"]
    rows, at = [], 0
    for i in range(800):
        at += rng.choice([500, 2000, 9000, 14_000])
        rows.append((rng.choice("ab"), f"c{i}", i, at, at + rng.choice([400, 1500, 30_000, 0]), rng.choice(texts[:3] if i % 50 < 25 else texts)))
    rows += rows[:40] + [(None, "z", 1, 0, 5, "x"), ("c", "z", 1, None, 5, "x"), ("c", "z", 2, 5, None, "x"), ("d", "o", 3, 7, 9, "x")]
    for chunk in (1_000, 60_000, 10**9):
        assert collapse(spark, rows, chunk=chunk) == brute(rows)


def test_one_run_over_many_chunks(spark):
    rows = [("a", f"c{i}", i, i * 1000, i * 1000 + 900, "la la la") for i in range(200)]
    assert collapse(spark, rows, chunk=3000) == [("a", 0, 199, 200, 0, 199_900)]


def test_pauses_break_runs_of_one_text(spark):
    rows = [("a", f"c{i}", i, s, s + 100, "same") for i, s in enumerate([0, 200, 20_000, 20_200, 20_400, 60_000])]
    assert [r[1:4] for r in collapse(spark, rows)] == [(0, 1, 2), (2, 4, 3), (5, 5, 1)]


def test_nulls_and_nothing(spark):
    assert collapse(spark, []) == []
    rows = [("a", "1", 0, 0, 5, None), ("a", "2", 1, 5, 9, None), ("a", "3", 2, 9, 12, ""), ("a", "4", 3, 12, 15, "?!")]
    assert [r[1:4] for r in collapse(spark, rows)] == [(0, 0, 1), (1, 1, 1), (2, 3, 2)]


def test_very_long_texts(spark):
    long = "abcdefghij" * 3000
    assert [r[3] for r in collapse(spark, [("a", "1", 0, 0, 5, long), ("a", "2", 1, 5, 9, long[:-200]), ("a", "3", 2, 9, 12, long[:1000])])] == [2, 1]
