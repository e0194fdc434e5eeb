"""Union of overlapping intervals per entity, and the holes between the united periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.operators.carry import carry_max, chunk_of
from cuespark.shared import checkpointed

CHUNK_MS = 600_000


def merge_intervals(intervals: DataFrame, entity: str, start: str, end: str, chunk: int = CHUNK_MS) -> DataFrame:
    """The maximal covered periods of each entity, over half-open intervals [start, end).

    Result: ``entity``, ``start``, ``end``, ``previous_end`` - the end of the entity's period before
    this one, null for its first. Intervals that touch join.

    Sort by start, compare each start with the running maximum of the earlier ends, label the
    islands, aggregate the periods. An entity is cut into chunks of ``chunk`` units of start, and
    intervals of one start are united before anything is sorted, so a window holds at most ``chunk``
    rows whatever the size of the entity; what a chunk has to know of earlier ones (the greatest
    end, the last island begun) comes through ``carry_max``. Copies are combined before the shuffle.

    Defined results: rows with a null entity, start or end, or with end <= start cover nothing.
    Repeated rows change nothing. An empty table gives an empty result. Other columns are ignored
    and may have any name. Negative starts are fine.
    """
    rows = (
        intervals.select(F.col(entity).alias("e"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("t"))
        .where("e is not null and s is not null and t > s")
        .withColumn("c", chunk_of(F.col("s"), chunk))
        .groupBy("e", "c", "s")
        .agg(F.max("t").alias("t"))
    )
    reach = carry_max(rows.groupBy("e", "c").agg(F.max("t").alias("v")), ["e"], "c", "v", "reach")
    order = Window.partitionBy("e", "c").orderBy("s")
    earlier, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = (
        rows.withColumn("p", F.max("t").over(earlier))
        .join(reach, ["e", "c"], "left")
        .withColumn("p", F.greatest("p", "reach"))
        .withColumn("begun", F.when(F.col("p").isNull() | (F.col("s") > F.col("p")), F.col("s")))
        .withColumn("label", F.max("begun").over(upto))
        .groupBy("e", "c", "label")
        .agg(F.max("t").alias("t"), F.max(F.when(F.col("begun").isNotNull(), F.col("p"))).alias("p"))
    )
    pieces = checkpointed(pieces)  # read to carry labels and for the result
    last = carry_max(pieces.groupBy("e", "c").agg(F.max("label").alias("v")), ["e"], "c", "v", "last")
    return (
        pieces.join(last, ["e", "c"], "left")
        .groupBy("e", F.coalesce("label", "last").alias("s"))
        .agg(F.max("t").alias("t"), F.max("p").alias("p"))
        .select(F.col("e").alias(entity), F.col("s").alias(start), F.col("t").alias(end), F.col("p").alias("previous_end"))
    )


def periods_and_gaps(intervals: DataFrame, entity: str, start: str, end: str, longest_gap: int | None = None, chunk: int = CHUNK_MS) -> DataFrame:
    """Rows of kind ``period`` and ``gap``: ``entity``, ``kind``, ``start``, ``end``.

    A gap lies between two neighbouring periods of an entity; gaps longer than ``longest_gap`` are
    left out (null: none is). The rules of ``merge_intervals`` hold.
    """
    periods = merge_intervals(intervals, entity, start, end, chunk)
    far = F.lit(True) if longest_gap is None else (F.col(start) - F.col("previous_end") <= longest_gap)
    none = F.lit(None).cast("struct<kind:string,s:bigint,t:bigint>")
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col(start).alias("s"), F.col(end).alias("t")),
        F.when(F.col("previous_end").isNotNull() & far, F.struct(F.lit("gap").alias("kind"), F.col("previous_end").alias("s"), F.col(start).alias("t"))).otherwise(none),
    )
    return (
        periods.select(F.col(entity), F.explode(both).alias("x"))
        .where("x is not null")
        .select(entity, F.col("x.kind").alias("kind"), F.col("x.s").alias(start), F.col("x.t").alias(end))
    )


def coverage(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Per entity: periods, covered length, first start, last end, and the total length of its gaps."""
    return merge_intervals(intervals, entity, start, end).groupBy(entity).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum(F.col(end) - F.col(start)).alias("covered"),
        F.min(start).alias("first_start"),
        F.max(end).alias("last_end"),
        F.coalesce(F.sum(F.col(start) - F.col("previous_end")), F.lit(0).cast("bigint")).alias("gap_total"),
    )
