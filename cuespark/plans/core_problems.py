"""Queries p1_... (intervals) and p4_... (rows that fail to parse)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.operators.intervals import coverage, periods_and_gaps
from cuespark.operators.rejects import Rule, find_unfit, load_fit
from cuespark.tables import load

LONGEST_GAP_MS = 600_000

ISSUE_RULES = [
    Rule("path", "present"),
    Rule("kind", "one_of", "unreadable|invalid|too-large|symlink|hardlink|unsafe"),
    Rule("size", "empty_or_bigint"),
    Rule("error_line", "empty_or_positive_int"),
    Rule("error", "any"),
    Rule("seen_at", "instant"),
]
ISSUE_TYPES = {"size": "bigint", "error_line": "int", "seen_at": "timestamp"}


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    # copies of a cue carry its times, so the union of intervals needs no row to be dropped
    return periods_and_gaps(load(spark, directory, "cues"), "path", "start_ms", "end_ms", LONGEST_GAP_MS)


def p1_coverage(spark: SparkSession, directory: str) -> DataFrame:
    return coverage(load(spark, directory, "cues"), "path", "start_ms", "end_ms")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_unfit(load(spark, directory, "raw_issues"), "line_id", "raw", ISSUE_RULES).select("line_id", "reason")


def p4_loaded(spark: SparkSession, directory: str) -> DataFrame:
    return load_fit(load(spark, directory, "raw_issues"), "line_id", "raw", ISSUE_RULES, ISSUE_TYPES)


def p4_reasons(spark: SparkSession, directory: str) -> DataFrame:
    unfit = find_unfit(load(spark, directory, "raw_issues"), "line_id", "raw", ISSUE_RULES)
    return unfit.groupBy("reason", F.array_join("fields", ",").alias("fields")).agg(F.count(F.lit(1)).alias("lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_coverage": p1_coverage,
    "p4_found": p4_found,
    "p4_loaded": p4_loaded,
    "p4_reasons": p4_reasons,
}

_ISLANDS = """
usable as (select path, start_ms, end_ms from cues where end_ms > start_ms and path is not null),
marked as (select *, max(end_ms) over (partition by path order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from usable),
numbered as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by path order by start_ms, end_ms rows unbounded preceding) as island from marked),
periods as (select path, island, min(start_ms) as start_ms, max(end_ms) as end_ms from numbered group by path, island),
followed as (select *, lag(end_ms) over (partition by path order by start_ms) as before from periods)
"""

_FIELD = """(?:"(?:[^"]|"")*"|[^",]*)"""
_CELLS = f"""
lines as (select line_id, raw, regexp_full_match(raw, '(?s){_FIELD}(?:,{_FIELD})*') as quoted from raw_issues),
cut as (select line_id, quoted, case when quoted then regexp_extract_all(',' || raw, '(?s),({_FIELD})', 1) end as quoted_cells from lines),
cells as (select line_id, quoted, list_transform(quoted_cells, lambda x: case when starts_with(x, '"') then replace(x[2:length(x) - 1], '""', '"') else x end) as c from cut),
digits as (select *, case when len(c) = 6 then ltrim(c[3], '0') end as size_digits, case when len(c) = 6 then ltrim(c[4], '0') end as line_digits from cells),
faults as (select *, list_filter([
    case when c[1] = '' then 'path' end,
    case when c[2] not in ('unreadable','invalid','too-large','symlink','hardlink','unsafe') then 'kind' end,
    case when not (c[3] = '' or (regexp_full_match(c[3], '[0-9]+') and (length(size_digits) < 19 or (length(size_digits) = 19 and size_digits <= '9223372036854775807')))) then 'size' end,
    case when not (c[4] = '' or (regexp_full_match(c[4], '[0-9]+') and line_digits <> '' and (length(line_digits) < 10 or (length(line_digits) = 10 and line_digits <= '2147483647')))) then 'error_line' end,
    case when not (regexp_full_match(c[6], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z') and try_cast(left(c[6], 10) as date) is not null) then 'seen_at' end
  ], lambda x: x is not null) as bad from digits),
judged as (select line_id, c, case when not quoted then 'quoting' when c is null or len(c) <> 6 then 'columns' when len(bad) > 0 then 'value' end as reason, bad from faults)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"""with {_ISLANDS}
select path, 'period' as kind, start_ms, end_ms from periods
union all
select path, 'gap' as kind, before as start_ms, start_ms as end_ms from followed where start_ms - before <= {LONGEST_GAP_MS}""",
    "p1_coverage": f"""with {_ISLANDS}
select path, count(*) as periods, cast(sum(end_ms - start_ms) as bigint) as covered, min(start_ms) as first_start, max(end_ms) as last_end,
  cast(coalesce(sum(start_ms - before), 0) as bigint) as gap_total from followed group by path""",
    "p4_found": f"with {_CELLS} select line_id, reason from judged where reason is not null",
    "p4_reasons": f"""with {_CELLS}
select reason, case when reason = 'value' then array_to_string(bad, ',') else '' end as fields, count(*) as lines from judged where reason is not null group by all""",
    "p4_loaded": f"""with {_CELLS}
select line_id, c[1] as path, nullif(c[2], '') as kind, cast(nullif(c[3], '') as bigint) as size, cast(nullif(c[4], '') as int) as error_line,
  nullif(c[5], '') as error, cast(replace(replace(c[6], 'T', ' '), 'Z', '') as timestamp) as seen_at from judged where reason is null""",
}
