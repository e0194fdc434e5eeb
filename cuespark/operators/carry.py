"""Running maxima across the chunks of a long sequence.

A window over one entity's whole sequence is one task, however long the sequence is. The operators
on sequences therefore cut an entity into chunks along its order, work inside the chunks, and need
only one thing from outside: the maximum of some value over all earlier chunks. ``carry_max`` gives
it in two levels, so that no window holds more than ``fanout`` chunks or the number of blocks of
``fanout`` chunks an entity spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 1024


def chunk_of(position: Column, width: int) -> Column:
    """Number of the chunk of ``width`` units that holds ``position`` (floored, also below zero)."""
    return _floor_div(position, F.lit(width).cast("bigint"))


def _floor_div(position: Column, wide: Column) -> Column:
    # exact for every bigint: the remainder is taken off first, so the quotient has no fraction
    return F.call_function("div", position - F.pmod(position, wide), wide)


def carry_max(chunks: DataFrame, entity: list[str], chunk: str, value: str, carry: str, fanout: int = FANOUT) -> DataFrame:
    """``entity``, ``chunk`` and the maximum of ``value`` over all smaller chunks of the entity.

    ``chunks`` has one row per (entity, chunk). The result has a row for each of them; ``carry`` is
    null where no earlier chunk has a value. Nulls in ``value`` are skipped.
    """
    block = "__block"
    within = Window.partitionBy(*entity, block).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*entity).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    inner = chunks.select(*entity, chunk, value).withColumn(block, _floor_div(F.col(chunk), F.lit(fanout).cast("bigint")))
    tops = (
        inner.groupBy(*entity, block)
        .agg(F.max(value).alias("__top"))
        .select(*entity, block, F.max("__top").over(above).alias("__before"))
    )
    return (
        inner.withColumn("__within", F.max(value).over(within))
        .join(tops, [*entity, block], "left")
        .select(*entity, chunk, F.greatest("__within", "__before").alias(carry))
    )
