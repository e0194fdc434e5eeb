"""Literal phrase search in cues: any of several phrases, with which of them matched."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespark.kernel.texts import normalize_search
from cuespark.operators.ranking import global_rank

FEW = 64  # phrases up to which each gets an expression; more go through one automaton
MOST_SENT = 200_000  # phrases of a table that are sent to all tasks
GRAM = 8  # characters of a phrase that longer tables are joined by


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases in order: their first spelling and their normalized form."""

    spellings: list[str]
    normalized: list[str]


def distinct_phrases(phrases: list[str]) -> Phrases:
    """Phrases without text dropped; of equal ones after normalization, the first spelling kept."""
    seen: dict[str, str] = {}
    for p in phrases:
        if form := normalize_search(p):
            seen.setdefault(form, p)
    return Phrases(list(seen.values()), list(seen))


def load_phrases(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one literal phrase per line as ``query_index``, ``query``, ``normalized``; see ``dedupe_phrases``.

    A phrase list is one small file and is read by one task, so that lines keep their order.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "query"))
    return dedupe_phrases(lines, "line", "query")


def dedupe_phrases(phrases: DataFrame, order: str, query: str) -> DataFrame:
    """``query_index`` (0, 1, ...), ``query`` (first spelling) and ``normalized`` of the distinct phrases of a table."""
    from cuespark.functions import normalize_search as form

    first = Window.partitionBy("normalized").orderBy("o", "query")
    kept = (
        phrases.select(F.col(order).alias("o"), F.col(query).alias("query"), form(F.col(query)).alias("normalized"))
        .where("normalized <> ''")
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
    )
    ranked = global_rank(kept, [F.col("o"), F.col("query")], "rank")
    return ranked.select((F.col("rank") - 1).cast("int").alias("query_index"), "query", "normalized")


def phrase_list(phrases: DataFrame, order: str, query: str) -> list[str]:
    """The phrases of a table in order, for ``search_any``; more than ``MOST_SENT`` are refused: ``search_table`` takes any number."""
    rows = phrases.orderBy(order).select(query).limit(MOST_SENT + 1).collect()
    if len(rows) > MOST_SENT:
        raise ValueError(f"more than {MOST_SENT} phrases")
    return [r[0] for r in rows if r[0] is not None]


def _automaton(normalized: list[str], indexes: list[int] | None = None) -> Column:
    import ahocorasick

    machine = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, p in zip(range(len(normalized)) if indexes is None else indexes, normalized):
        by.setdefault(p, []).append(i)
    for p, found in by.items():
        machine.add_word(p, found)
    machine.make_automaton()

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({i for _, hits in machine.iter(t) for i in hits}) if t else [] for t in texts], dtype=object)

    return found("search_text")


def search_any(cues: DataFrame, phrases: list[str]) -> DataFrame:
    """The cues that hold any of the phrases, with ``query_indexes`` (ascending) and ``matched_phrases`` (spellings).

    A phrase that occurs several times in a cue counts once. No usable phrase: no row. Null search
    texts match nothing. Every row of ``cues`` is looked at by itself: nothing is shuffled.
    """
    wanted = distinct_phrases(phrases)
    if not wanted.normalized:
        return cues.withColumns({"query_indexes": F.array().cast("array<int>"), "matched_phrases": F.array().cast("array<string>")}).where(F.lit(False))
    hits = [F.col("search_text").contains(p) for p in wanted.normalized]
    if len(hits) <= FEW:
        either = hits[0]
        for hit in hits[1:]:
            either = either | hit
        found = cues.where(either).withColumn("query_indexes", F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hits)])))
    else:
        found = cues.withColumn("query_indexes", _automaton(wanted.normalized)).where(F.size("query_indexes") > 0)
    spellings = F.array(*[F.lit(s) for s in wanted.spellings])
    return found.withColumn("matched_phrases", F.transform("query_indexes", lambda i: F.get(spellings, i)))


def search_table(cues: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``query_indexes`` of the cues that hold any phrase of a table (``query_index``, ``normalized``).

    The table is measured first. Few phrases become expressions, up to ``MOST_SENT`` one automaton, which
    is sent; then every cue is looked at by itself. A larger table is joined by equality: a phrase by its
    first ``GRAM`` characters (all, if it has fewer), a text by all its stretches of such lengths; what
    meets is compared in full. Blank and null phrases are in no text. All three give the same rows.
    """
    wanted = phrases.select("query_index", "normalized").where("normalized <> ''").distinct()
    rows = sorted(wanted.limit(MOST_SENT + 1).collect())
    if len(rows) > MOST_SENT:
        return _search_by_grams(cues, wanted, key)
    if len(rows) > FEW:
        found = cues.withColumn("query_indexes", _automaton([r.normalized for r in rows], [r.query_index for r in rows]))
    else:
        hits = [F.when(F.col("search_text").contains(r.normalized), F.lit(r.query_index)) for r in rows]
        found = cues.withColumn("query_indexes", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>"))
    return found.where(F.size("query_indexes") > 0).select(*key, "query_indexes")


def _search_by_grams(cues: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    lengths = [r[0] for r in phrases.select(F.least(F.length("normalized"), F.lit(GRAM))).distinct().collect()]  # GRAM numbers at most
    text = F.col("search_text")
    # the end before the start: a text shorter than the stretch has none
    stretches = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = cues.select(*key, "search_text", F.explode(F.array_distinct(F.concat(*[stretches(n) for n in sorted(lengths)]))).alias("gram"))
    listed = phrases.select(F.substring("normalized", 1, GRAM).alias("gram"), "query_index", "normalized")
    pairs = grams.join(listed, "gram").where(F.col("search_text").contains(F.col("normalized")))
    return pairs.groupBy(*key).agg(F.array_sort(F.collect_set("query_index")).alias("query_indexes"))


def search_one(cues: DataFrame, phrase: str) -> DataFrame:
    """The cues that hold the phrase."""
    form = normalize_search(phrase)
    return cues.where(F.col("search_text").contains(form)) if form else cues.where(F.lit(False))


def search_summary(matches: DataFrame, files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: ``matching_cues``, ``matching_files``, ``scanned_files``, ``skipped_files``."""
    return (
        matches.agg(F.count(F.lit(1)).alias("matching_cues"), F.count_distinct("path").alias("matching_files"))
        .crossJoin(files.agg(F.count(F.lit(1)).alias("scanned_files")))  # each side is one row
        .crossJoin(issues.agg(F.count(F.lit(1)).alias("skipped_files")))
    )


def preview(cues: DataFrame, most: int = 5) -> DataFrame:
    """The first cues of each file, by ordinal."""
    return cues.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))).where(F.col("__n") <= most).drop("__n")


def editor_filter(cues: DataFrame, phrase: str) -> DataFrame:
    """The cues of an open file that hold the phrase; a phrase without text keeps all."""
    return search_one(cues, phrase) if normalize_search(phrase) else cues


def page(cues: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of an open file's cues, in source order."""
    return cues.orderBy("ordinal").offset(number * size).limit(size)
