"""The functions and views of the engine for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cuespark.functions.columns import _each
from cuespark.kernel import texts
from cuespark.kernel.formats import parse
from cuespark.kernel.rewrite import delete_cues
from cuespark.kernel.source import Malformed
from cuespark.operators.discovery import Discovery
from cuespark.operators.parse import parsed_row


def register_functions(spark: SparkSession) -> None:
    """``normalize_search``, ``normalize_display``, ``project_markup``, ``project_ass``, ``parse_cues``, ``render_deletion``."""
    kernels = {
        "normalize_search": texts.normalize_search,
        "normalize_display": texts.normalize_display,
        "project_markup": lambda t: texts.visible_markup(t, False),
        "project_ass": texts.visible_ass,
    }
    for name, kernel in kernels.items():
        spark.udf.register(name, F.pandas_udf(_series(kernel), "string"))

    @F.udtf(returnType="ordinal int, cue_id string, start_ms bigint, end_ms bigint, display_text string, search_text string, error string")
    class ParseCues:
        """Rows of one file: its cues, or one row with the error."""

        def eval(self, content: bytes, form: str) -> Iterator[tuple]:
            made = parsed_row("", form or "", content or b"")
            if made["error"]:
                yield None, None, None, None, None, None, made["error"].removeprefix(":").strip()
            for c in made["cues"] or []:
                yield c["ordinal"], c["cue_id"], c["start_ms"], c["end_ms"], c["display_text"], c["search_text"], None

    spark.udtf.register("parse_cues", ParseCues)

    @F.pandas_udf("binary")
    def render(contents: pd.Series, forms: pd.Series, ids: pd.Series) -> pd.Series:
        def one(content: bytes | None, form: str | None, gone: list[str] | None) -> bytes | None:
            if content is None or form is None or gone is None:
                return None
            try:
                return delete_cues(bytes(content), parse(bytes(content), form), list(gone))
            except Malformed:
                return None

        return pd.Series([one(*x) for x in zip(contents, forms, ids)], dtype=object)

    spark.udf.register("render_deletion", render)


def _series(kernel):
    over = _each(kernel)

    def run(values: pd.Series) -> pd.Series:
        return over(values)

    return run


def register_views(found: Discovery) -> None:
    """Views ``files``, ``issues`` and ``cues`` of a scan."""
    for name in ("files", "issues", "cues"):
        getattr(found, name).createOrReplaceTempView(name)
