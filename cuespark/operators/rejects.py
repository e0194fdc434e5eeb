"""Loading of delimited lines with the unfit ones set apart, each with its reason.

A line is cut into cells by the quoting rules, the cells are exploded to (line, column, value),
joined with a table of rules - one rule per column - and validated; the failures are aggregated per
line, and the good lines are what an anti-join with them leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stand-ins for a delimiter between cells and for themselves inside cells, while cells are strings.
_CUT, _ESC = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    """What a column's values must be: ``check`` is one of ``CHECKS``, ``argument`` its parameter."""

    column: str
    check: str
    argument: str = ""


def _digits(value: Column, least: int, most: int) -> Column:
    """ASCII digits (leading zeros allowed) whose number lies in least..most; exact at any length."""
    bare = F.regexp_replace(value, "^0+", "")
    top = str(most)
    small = (F.length(bare) < len(top)) | ((F.length(bare) == len(top)) & (bare <= top))
    return value.rlike(r"^[0-9]+\z") & small & ((F.length(bare) > 0) if least > 0 else F.lit(True))


def _instant(value: Column) -> Column:
    """A real time ``YYYY-MM-DDTHH:MM:SSZ`` of the years 0001 to 9999."""
    at = lambda i, n: F.substring(value, i, n).cast("int")
    year, month, day = at(1, 4), at(6, 2), at(9, 2)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    form = value.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z")
    # a case expression, so that the casts see only values of the right form
    return F.when(form, (year >= 1) & (day <= days)).otherwise(False)


CHECKS = {
    "any": lambda value, argument: F.lit(True),
    "present": lambda value, argument: value != "",
    "one_of": lambda value, argument: F.array_contains(F.split(argument, r"\|"), value),
    "empty_or_bigint": lambda value, argument: (value == "") | _digits(value, 0, 2**63 - 1),
    "empty_or_positive_int": lambda value, argument: (value == "") | _digits(value, 1, 2**31 - 1),
    "instant": lambda value, argument: _instant(value),
}


def segments(raw: Column) -> Column:
    """``raw`` cut at every quote: even elements lie outside of quoted fields, odd ones inside.

    This holds for well quoted lines; an empty even element between two odd ones is a doubled quote.
    """
    return F.split(raw, '"', -1)


def well_quoted(parts: Column) -> Column:
    """Whether quotes only open at the start of a field and only close at its end."""
    even = F.transform(parts, lambda x, i: F.when((i % 2) == 0, F.struct(i.alias("i"), x.alias("x"))))
    last = F.size(parts) - 1
    opens = lambda e: (e["i"] == 0) | (e["x"] == "") | e["x"].startswith(",")
    closes = lambda e: (e["i"] == last) | (e["x"] == "") | e["x"].endswith(",")
    fits = lambda e: e.isNull() | (opens(e) & closes(e))
    return (F.size(parts) % 2 == 1) & F.forall(even, fits)


def cells(parts: Column) -> Column:
    """The cells of a well quoted line, unquoted, with doubled quotes made single."""
    last = F.size(parts) - 1
    guard = lambda x: F.replace(F.replace(x, F.lit(_ESC), F.lit(_ESC + "b")), F.lit(_CUT), F.lit(_ESC + "a"))
    piece = lambda x, i: (
        F.when((i % 2) == 1, guard(x)).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(guard(x), F.lit(","), F.lit(_CUT)))
    )
    joined = F.array_join(F.transform(parts, piece), "")
    back = lambda x: F.replace(F.replace(x, F.lit(_ESC + "a"), F.lit(_CUT)), F.lit(_ESC + "b"), F.lit(_ESC))
    return F.transform(F.split(joined, _CUT, -1), back)


def parse_lines(lines: DataFrame, line_id: str, raw: str, width: int) -> DataFrame:
    """``id``, ``cells`` and ``broken``: ``quoting`` or ``columns`` for lines that can't be cut into ``width`` cells."""
    cut = lines.select(F.col(line_id).alias("id"), segments(F.col(raw)).alias("parts"))
    cut = cut.withColumn("quoted", well_quoted(F.col("parts")))
    cut = cut.select("id", "quoted", F.when(F.col("quoted"), cells(F.col("parts"))).alias("cells"))
    broken = F.when(F.col("quoted") == False, "quoting").when(F.col("cells").isNull() | (F.size("cells") != width), "columns")  # noqa: E712
    return cut.select("id", "cells", broken.alias("broken"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table ``position``, ``field``, ``check``, ``argument``; as long as a line is wide."""
    rows = [(i, r.column, r.check, r.argument) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "position int, field string, check string, argument string")


def find_unfit(lines: DataFrame, line_id: str, raw: str, rules: list[Rule]) -> DataFrame:
    """``line_id``, ``reason`` and the failing ``fields`` (in column order) of each unfit line.

    ``reason`` is the first that holds of ``quoting`` (a quote inside a bare field, an unclosed
    quoted field, or text after a closing quote), ``columns`` (another number of cells than rules) and
    ``value`` (a cell fails its column's rule). Nothing is trimmed. The line id names a line: of a
    repeated id the first reason in that order is given, once. A null raw text has no cells: ``columns``. A null id is an id like
    any other. Work per line is linear in its length, so very long lines are fine.
    """
    parsed = parse_lines(lines, line_id, raw, len(rules))
    checks = rule_table(lines.sparkSession, rules)
    verdict = F.coalesce(*[F.when(F.col("check") == k, f(F.col("value"), F.col("argument"))) for k, f in CHECKS.items()])
    empty = F.array(F.lit(None).cast("string"))
    exploded = parsed.select("id", "broken", F.posexplode(F.when(F.col("broken").isNull(), F.col("cells")).otherwise(empty)).alias("position", "value"))
    failed = (
        exploded.join(F.broadcast(checks), "position")  # one row per column of the format
        .where(F.col("broken").isNotNull() | ~F.coalesce(verdict, F.lit(False)))
        .groupBy("id")
        .agg(
            F.min_by("broken", F.when(F.col("broken") == "quoting", 0).when(F.col("broken") == "columns", 1)).alias("broken"),
            F.array_sort(F.collect_set(F.when(F.col("broken").isNull(), F.struct("position", "field")))).alias("fields"),
        )
    )
    return failed.select(F.col("id").alias(line_id), F.coalesce("broken", F.lit("value")).alias("reason"), F.transform("fields", lambda x: x["field"]).alias("fields"))


def load_fit(lines: DataFrame, line_id: str, raw: str, rules: list[Rule], types: dict[str, str]) -> DataFrame:
    """The fit lines as typed columns, one per rule, beside ``line_id``: the lines without a failure.

    Rows of an id that has an unfit row are all left out; repeated fit rows are all kept.

    Empty cells become null, except in columns with the rule ``present``. ``types`` gives the
    columns that aren't strings: ``bigint``, ``int`` or ``timestamp``.
    """
    unfit = find_unfit(lines, line_id, raw, rules).select(line_id)
    parsed = parse_lines(lines, line_id, raw, len(rules)).select(F.col("id").alias(line_id), "cells")
    kept = parsed.join(unfit, parsed[line_id].eqNullSafe(unfit[line_id]), "left_anti")

    def typed(i: int, rule: Rule) -> Column:
        value = F.element_at("cells", i + 1)
        value = value if rule.check == "present" else F.nullif(value, F.lit(""))
        kind = types.get(rule.column)
        if kind == "timestamp":
            return F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias(rule.column)
        return (value.try_cast(kind) if kind else value).alias(rule.column)

    return kept.select(line_id, *[typed(i, r) for i, r in enumerate(rules)])
