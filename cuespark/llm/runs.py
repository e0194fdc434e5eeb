"""Runs of consecutive equal or nearly equal events, collapsed to one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.operators.carry import carry_max, chunk_of
from cuespark.shared import checkpointed

CHUNK_MS = 600_000
LONGEST_PAUSE_MS = 10_000
TENTH = 10
CROWD = 100_000  # events in one chunk from which an entity's chunks are made narrower
MOST_SENT = 100_000  # crowded entities that are sent to all tasks


def canonical_text(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def texts_agree(a: Column, b: Column, part: int = TENTH) -> Column:
    """Whether two canonical texts have the same digits and an edit distance of at most 1/``part`` of the longer one.

    Null agrees with nothing. The distance is banded: its cost is length times allowed edits, and it
    is not computed where the lengths or the digits rule it out.
    """
    longest = F.greatest(F.length(a), F.length(b))
    allowed = F.floor(longest / part).cast("int")
    digits = lambda x: F.regexp_replace(x, r"\P{N}", "")
    near = (F.abs(F.length(a) - F.length(b)) <= allowed) & (digits(a) == digits(b)) & (F.call_function("levenshtein", a, b, allowed) >= 0)
    return F.coalesce((a == b) | (near), F.lit(False))


def _chunked(rows: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the chunk ``c`` of each, and the last event ``v`` of every chunk.

    Chunks are ``chunk`` units wide, or narrower for entities that crowd one.
    """
    event = F.max(F.struct("s", "o", "t", "x")).alias("v")
    placed = rows.withColumn("c", chunk_of(F.col("s"), chunk))
    chunks = checkpointed(placed.groupBy("e", "c").agg(F.count(F.lit(1)).alias("n"), event))  # a row per chunk
    narrow = chunks.groupBy("e").agg(F.max("n").alias("n")).where(F.col("n") > CROWD).select("e", F.greatest(F.lit(1), F.floor(F.lit(chunk) / F.ceil(F.col("n") / CROWD))).cast("bigint").alias("width"))
    found = narrow.count()
    if not found:
        return placed, chunks.drop("n")
    width = F.coalesce("width", F.lit(chunk).cast("bigint"))
    widths = rows.join(F.broadcast(narrow) if found <= MOST_SENT else narrow, "e", "left")
    placed = widths.withColumn("c", F.call_function("div", F.col("s") - F.pmod("s", width), width)).drop("width")
    return placed, placed.groupBy("e", "c").agg(event)


def collapse_runs(
    events: DataFrame,
    entity: str,
    key: str,
    ordinal: str,
    start: str,
    end: str,
    text: str,
    pause: int = LONGEST_PAUSE_MS,
    chunk: int = CHUNK_MS,
) -> DataFrame:
    """Each maximal run of an entity's consecutive events whose texts agree, single events included.

    Result: ``entity``, ``first_ordinal``, ``last_ordinal``, ``count``, ``start``, ``end``, ``duration``
    (first start to last end, the greatest of the run).

    Events are taken by start, then ordinal. An event continues the one before it if their texts
    agree (``texts_agree``) and it starts at most ``pause`` after the other's end. Every event then
    takes the canonical text of the event its chain began with; where a chain breaks though that text
    stays the same (a pause), one position is skipped. The position of the event less its row number
    within its text is constant over a run and differs between runs of one text, so (text,
    difference) identifies the runs.

    All of this happens within chunks of ``chunk`` units of start. A chunk gets the last event before
    it and the last run begun before it by ``carry_max``. An entity with more than ``CROWD`` events in
    a chunk gets chunks narrower by that factor (one unit at least), so that a window grows neither with an
    entity nor with a crowd; only events of one and the same start always share one. Two
    passes read the events: for the sizes and last events of the chunks, and for the runs.

    Defined results: rows with a null entity, start or end, or end <= start, are no events. Copies of
    an event (alike in ``entity``, ``key``, ordinal, times and text) count once. Events that tie in start
    and ordinal are ordered by end and text. A null text is a run of its own. Texts without letters
    and digits agree with each other. An empty table gives an empty result.
    """
    rows = (
        events.select(
            F.col(entity).alias("e"), F.col(key).alias("k"), F.col(ordinal).alias("o"),
            F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("t"), canonical_text(F.col(text)).alias("x"),
        )
        .where("e is not null and s is not null and t > s")
    )
    rows, chunks = _chunked(rows, chunk)
    before = carry_max(chunks, ["e"], "c", "v", "before")
    # one shuffle by chunk: copies are dropped, and windows run, where it put them
    rows = rows.repartition("e", "c").distinct().select("e", "c", "s", "o", "t", "x")
    order = Window.partitionBy("e", "c").orderBy("s", "o", "t", "x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    linked = (
        rows.withColumn("n", F.row_number().over(order))
        .withColumn("px", F.lag("x").over(order))
        .withColumn("pt", F.lag("t").over(order))
        .join(before, ["e", "c"], "left")
        .withColumn("px", F.when(F.col("n") == 1, F.col("before.x")).otherwise(F.col("px")))
        .withColumn("pt", F.when(F.col("n") == 1, F.col("before.t")).otherwise(F.col("pt")))
        .withColumn("goes_on", F.coalesce(F.col("s") - F.col("pt") <= pause, F.lit(False)) & texts_agree(F.col("px"), F.col("x")))
        .drop("before", "pt")
    )
    # the text a chain began with; a chain that began in an earlier chunk goes by its last text there
    began = F.last(F.when(~F.col("goes_on"), F.struct("x")), ignorenulls=True).over(upto)
    first_px = F.first(F.struct("px")).over(upto)
    canon = (
        linked.withColumn("v", F.coalesce(began, F.struct(first_px["px"].alias("x")))["x"])
        .withColumn("skip", F.when(~F.col("goes_on") & F.lag("v").over(order).eqNullSafe(F.col("v")), 1).otherwise(0))
        .withColumn("position", F.col("n") + F.sum("skip").over(upto))
        .withColumn("d", F.col("position") - F.row_number().over(Window.partitionBy("e", "c", "v").orderBy("s", "o", "t", "x")))
    )
    runs = canon.groupBy("e", "c", "v", "d").agg(
        F.count(F.lit(1)).alias("count"),
        F.max(F.when(~F.col("goes_on"), F.col("n"))).alias("hn"),
        F.min_by("o", "n").alias("first_o"),
        F.max_by("o", "n").alias("last_o"),
        F.min("s").alias("s"),
        F.max("t").alias("t"),
    )
    # a run is named by its chunk and the row number of its first event there; read to carry names and for the result
    runs = checkpointed(runs.withColumn("name", F.when(F.col("hn").isNotNull(), F.struct("c", "hn"))).drop("v", "d", "hn"))
    last = carry_max(runs.groupBy("e", "c").agg(F.max("name").alias("w")), ["e"], "c", "w", "last")
    return (
        runs.join(last, ["e", "c"], "left")
        .withColumn("name", F.coalesce("name", "last"))
        .groupBy("e", F.col("name.c").alias("nc"), F.col("name.hn").alias("nn"))
        .agg(
            F.min_by("first_o", "c").alias("first_ordinal"),
            F.max_by("last_o", "c").alias("last_ordinal"),
            F.sum("count").alias("count"),
            F.min("s").alias("s"),
            F.max("t").alias("t"),
        )
        .select(
            F.col("e").alias(entity), "first_ordinal", "last_ordinal", "count",
            F.col("s").alias(start), F.col("t").alias(end), (F.col("t") - F.col("s")).alias("duration"),
        )
    )
