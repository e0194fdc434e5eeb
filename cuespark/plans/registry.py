"""All queries of the core, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuespark.plans import core_problems, marked_queries, reference_queries, tree_queries

MODULES = [core_problems, reference_queries, tree_queries, marked_queries]
FLAGSHIP = "search_any_phrases"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
