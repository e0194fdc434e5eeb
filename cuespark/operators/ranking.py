"""Positions in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.shared import checkpointed

_SHIFT = 33  # partition numbers stand above this bit of a monotonic id
CROWD = 1_000_000  # rows of one key that a window may hold


def _placed(frame: DataFrame, order: list[Column]) -> DataFrame:
    """The rows sorted by ranges and written once, with ``__id``: the number of their range above ``_SHIFT``, their place in it below."""
    return checkpointed(frame.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))


def _before(parts: DataFrame, values: list[str]) -> DataFrame:
    """``__part`` and, for each value, its sum over all earlier ranges; a row per range."""
    order = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("__part", *[F.coalesce(F.sum(v).over(order), F.lit(0)).alias(f"__before_{v}") for v in values])


def global_rank(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``frame`` with the position of each row (1, 2, ...) in a total order.

    The rows are sorted by ranges and written once with their place in their range; the sizes of the
    ranges, one number per range, give the rest. Ties are ordered arbitrarily, but consistently.
    """
    placed = _placed(frame, order).withColumn("__part", F.shiftright("__id", _SHIFT))
    offsets = _before(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    rank = F.col("__before_rows") + (F.col("__id") - F.shiftleft(F.col("__part"), _SHIFT)) + 1
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, rank).drop("__part", "__id", "__before_rows")


def running_totals(frame: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``frame`` with the sums of some values over all rows up to each, in a total order.

    Sums run within ranges of the sorted rows; those of earlier ranges are added, one row per range.
    """
    valued = frame.withColumns({f"__{name}": value for name, value in sums.items()})
    placed = _placed(valued, order).withColumn("__part", F.shiftright("__id", _SHIFT))
    offsets = _before(placed.groupBy("__part").agg(*[F.sum(f"__{name}").alias(name) for name in sums]), list(sums))
    within = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    totals = {name: F.coalesce(F.sum(f"__{name}").over(within), F.lit(0)) + F.col(f"__before_{name}") for name in sums}
    return placed.join(F.broadcast(offsets), "__part").select(*frame.columns, *[v.alias(k) for k, v in totals.items()])


def number_in(frame: DataFrame, key: str, order: list[str], name: str, crowd: int | None = None, bound: DataFrame | None = None) -> DataFrame:
    """``frame`` with the position (1, 2, ...) of each row among those of its ``key``.

    The keys are counted first, in ``bound`` if it is given: a frame that has of each key as many rows at
    least, and is cheaper to count. Where none has more than ``crowd`` rows (``CROWD``), a window per key
    numbers them; else the rows are ranked over ranges that split any key, and a key's positions begin
    after the rank of its first row. Both give the same numbers.
    """
    crowded = (frame if bound is None else bound).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (CROWD if crowd is None else crowd))
    if crowded.isEmpty():
        return frame.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint"))
    ranked = global_rank(frame, [F.col(key), *[F.col(o) for o in order]], "__rank")
    first = ranked.groupBy(F.col(key).alias("__key")).agg(F.min("__rank").alias("__first"))
    joined = ranked.join(first, F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn(name, F.col("__rank") - F.col("__first") + 1).drop("__rank", "__key", "__first")
