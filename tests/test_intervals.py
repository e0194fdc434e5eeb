import random

from cuespark.operators.carry import carry_max
from cuespark.operators.intervals import coverage, merge_intervals, periods_and_gaps

SCHEMA = "path string, start_ms bigint, end_ms bigint, s string, e int, reach int"


def brute(rows, longest=None):
    out = set()
    by = {}
    for p, s, t in rows:
        if p is not None and s is not None and t is not None and t > s:
            by.setdefault(p, []).append((s, t))
    for p, spans in by.items():
        periods = []
        for s, t in sorted(spans):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], t)
            else:
                periods.append([s, t])
        out |= {(p, "period", s, t) for s, t in periods}
        out |= {(p, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:]) if longest is None or b[0] - a[1] <= longest}
    return out


def table(spark, rows):
    return spark.createDataFrame([(p, s, t, "x", 1, 2) for p, s, t in rows], SCHEMA)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for p in "abc":
        for _ in range(300):
            s = rng.randrange(-500, 20_000)
            rows.append((p, s, s + rng.choice([1, 5, 40, 700, 0, -3])))
    rows += rows[:50] + [("d", 0, 10), ("d", 10, 20), ("e", 5, 5), (None, 1, 2), ("f", None, 2), ("f", 1, None), ("g", 0, 10**6), ("g", 500, 600), ("g", 2 * 10**6, 2 * 10**6 + 1)]
    for chunk in (1, 7, 1000, 10**7):
        got = {tuple(r) for r in periods_and_gaps(table(spark, rows), "path", "start_ms", "end_ms", 300, chunk).collect()}
        assert got == brute(rows, 300)


def test_no_row_is_repeated_and_empty_tables_are_fine(spark):
    assert periods_and_gaps(table(spark, []), "path", "start_ms", "end_ms").collect() == []
    rows = [("a", 1, 5)] * 4 + [("a", 3, 9)]
    assert [tuple(r) for r in merge_intervals(table(spark, rows), "path", "start_ms", "end_ms").collect()] == [("a", 1, 9, None)]


def test_coverage(spark):
    got = coverage(table(spark, [("a", 0, 10), ("a", 5, 12), ("a", 20, 21)]), "path", "start_ms", "end_ms").collect()
    assert [tuple(r) for r in got] == [("a", 2, 13, 0, 21, 8)]


def test_carry_over_blocks(spark):
    chunks = spark.createDataFrame([("a", c, v) for c, v in [(-3, 9), (0, None), (1, 4), (5, 12), (9, 1)]], "e string, c bigint, v bigint")
    got = {r.c: r.carry for r in carry_max(chunks, ["e"], "c", "v", "carry", fanout=2).collect()}
    assert got == {-3: None, 0: 9, 1: 9, 5: 9, 9: 12}
