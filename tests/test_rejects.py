import csv
import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cuespark.operators.rejects import Rule, find_unfit, load_fit, parse_lines
from cuespark.plans.core_problems import ISSUE_RULES, ISSUE_TYPES

GOOD = "a/b.srt,invalid,12,3,text,2030-01-02T03:04:05Z"
CASES = {
    GOOD: None,
    '"a, b.srt",invalid,,,"say ""x""\nagain",2030-01-02T03:04:05Z': None,
    "a.srt,invalid,00000000000000000000000000001,1,,2028-02-29T23:59:59Z": None,
    "a.srt,invalid,9223372036854775807,2147483647,,2030-01-02T03:04:05Z": None,
    'a"b.srt,invalid,,,,2030-01-02T03:04:05Z': "quoting",
    '"a.srt,invalid,,,,2030-01-02T03:04:05Z': "quoting",
    '"a.srt"x,invalid,,,,2030-01-02T03:04:05Z': "quoting",
    'a.srt, "invalid",,,,2030-01-02T03:04:05Z': "quoting",
    '"""': "quoting",
    '"': "quoting",
    "": "columns",
    '""': "columns",
    "a.srt,invalid,,,2030-01-02T03:04:05Z": "columns",
    GOOD + ",": "columns",
    ",invalid,,,,2030-01-02T03:04:05Z": "value",
    "a.srt,Invalid,,,,2030-01-02T03:04:05Z": "value",
    "a.srt, invalid,,,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid|symlink,,,,2030-01-02T03:04:05Z": "value",
    "a.srt,,,,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid,9223372036854775808,,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid,-1,,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid,١,,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid,,0,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid,,2147483648,,2030-01-02T03:04:05Z": "value",
    "a.srt,invalid,,,,2029-02-29T03:04:05Z": "value",
    "a.srt,invalid,,,,2100-02-29T03:04:05Z": "value",
    "a.srt,invalid,,,,2030-01-02T24:00:00Z": "value",
    "a.srt,invalid,,,,2030-01-02T03:04:60Z": "value",
    "a.srt,invalid,,,,2030-01-02T03:04:05Z\n": "value",
    "a.srt,invalid,,,,0000-01-02T03:04:05Z": "value",
    "a.srt,invalid,,,,": "value",
}


def table(spark, raws):
    return spark.createDataFrame([(i, r, "x", 1) for i, r in enumerate(raws)], "line_id bigint, raw string, reason string, position int")


def test_reasons(spark):
    got = {r.line_id: r.reason for r in find_unfit(table(spark, CASES), "line_id", "raw", ISSUE_RULES).collect()}
    assert {raw: got.get(i) for i, raw in enumerate(CASES)} == CASES


def test_fields_are_named_in_order(spark):
    got = find_unfit(table(spark, [",x,y,z,,"]), "line_id", "raw", ISSUE_RULES).collect()
    assert [(r.reason, r.fields) for r in got] == [("value", ["path", "kind", "size", "error_line", "seen_at"])]


def test_load(spark):
    rows = load_fit(table(spark, [*CASES, None, GOOD]), "line_id", "raw", ISSUE_RULES, ISSUE_TYPES).orderBy("line_id").collect()
    assert [r.line_id for r in rows] == [i for i, (_, why) in enumerate(CASES.items()) if why is None] + [len(CASES) + 1]
    assert (rows[0].path, rows[0].size, rows[0].error_line, str(rows[0].seen_at)) == ("a/b.srt", 12, 3, "2030-01-02 03:04:05")
    assert (rows[1].path, rows[1].size, rows[1].error) == ("a, b.srt", None, 'say "x"\nagain')
    assert load_fit(table(spark, []), "line_id", "raw", ISSUE_RULES, ISSUE_TYPES).collect() == []


def test_null_repeated_and_very_long_lines(spark):
    long = '"' + '""' * 300_000 + '",invalid,,,,2030-01-02T03:04:05Z'
    lines = spark.createDataFrame([(1, None), (2, '"'), (2, "x"), (3, long), (4, "," * 100_000), (None, "x")], "line_id bigint, raw string")
    got = {r.line_id: r.reason for r in find_unfit(lines, "line_id", "raw", ISSUE_RULES).collect()}
    assert got == {1: "columns", 2: "quoting", 4: "columns", None: "columns"}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8")), min_size=1, max_size=7), min_size=1, max_size=20))
def test_cells_round_trip(spark, lines):
    def write(cells):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(cells)
        return out.getvalue()

    rules = [Rule(f"c{i}", "any") for i in range(3)]
    got = parse_lines(table(spark, [write(c) for c in lines]), "line_id", "raw", len(rules)).orderBy("id").collect()
    assert [r.cells for r in got] == lines
    assert [r.broken for r in got] == [None if len(c) == 3 else "columns" for c in lines]
