"""SRT parsing in built-in expressions and windows, for UTF-8 files that are rows of a table.

The kernel path (``operators.parse``) handles every encoding and tells each failure; this one keeps
bytes and lines in the JVM and only sends payloads to Python, for their visible text. Both give the
same cues, and none for a file with any failure. A file above ``MOST_BYTES``, which a scan reports as too
large, has none either; so no window, which holds the lines of one file, grows beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.functions import cue_id, is_blank, normalize_display, normalize_search, numeric_token, parse_clock, visible_markup
from cuespark.kernel.files import MOST_BYTES

_LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"
_TIMING = r"(?s)^[\t\n\f\r ]*([^\t\n\f\r ]+)[\t\n\f\r ]*-->[\t\n\f\r ]*([^\t\n\f\r ]+)(?:[\t\n\f\r ]+.*)?\z"


def _numbered_lines(files: DataFrame, path: str, content: str) -> DataFrame:
    """``path``, ``n``, ``text`` and the byte offsets ``start`` and ``next`` of every line."""
    marked = F.hex(F.substring(F.col(content), 1, 3)) == "EFBBBF"
    rows = files.select(F.col(path).alias("path"), F.col(content).alias("raw"), F.when(marked, 3).otherwise(0).cast("bigint").alias("mark"))
    rows = rows.withColumn("body", F.expr("substring(raw, cast(mark as int) + 1)").cast("string")).where(F.is_valid_utf8("body") & (F.octet_length("raw") <= MOST_BYTES))
    lines = rows.select("path", "mark", F.posexplode(F.regexp_extract_all("body", F.lit(_LINE), F.lit(0))).alias("n", "line"))
    order = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sized = lines.withColumn("size", F.octet_length("line").cast("bigint")).withColumn("next", F.col("mark") + F.sum("size").over(order))
    return sized.select("path", "n", F.regexp_replace("line", r"[\r\n]+\z", "").alias("text"), (F.col("next") - F.col("size")).alias("start"), "next", "mark")


def parse_srt_native(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path``, ``ordinal``, ``cue_id``, times, texts and spans of the cues of all valid UTF-8 files.

    Blocks are the groups of lines between blank ones; the first owns the blank lines before it, each
    those after it. Within a block the first line is the number, the second the times, the rest the
    payload. A file with one wrong block has no cues.
    """
    lines = _numbered_lines(files, path, content).withColumn("blank", is_blank(F.col("text")))
    order = Window.partitionBy("path").orderBy("n")
    begins = ~F.col("blank") & F.coalesce(F.lag("blank").over(order), F.lit(True))
    block = F.greatest(F.lit(1), F.sum(F.when(begins, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = (
        lines.withColumn("block", block)
        .groupBy("path", "block")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("blank"), F.struct("n", "text", "start")))).alias("lines"),
            F.min("start").alias("first"),
            F.max("next").alias("last"),
        )
        .where(F.size("lines") > 0)
    )
    at = lambda i: F.get("lines", F.lit(i))
    side = lambda i: F.regexp_extract(at(1)["text"], _TIMING, i)
    payload = F.slice("lines", F.lit(3), F.greatest(F.size("lines") - 2, F.lit(0)))
    timing = lambda x: F.coalesce(x.rlike(_TIMING), F.lit(False))
    run_on = F.exists(F.zip_with(payload, F.slice(payload, F.lit(2), F.greatest(F.size(payload), F.lit(0))), lambda a, b: _numeric(a["text"]) & timing(b["text"])), lambda x: F.coalesce(x, F.lit(False)))
    cues = grouped.withColumns(
        {
            "token": numeric_token(at(0)["text"]),
            "start_ms": parse_clock(side(1), ",."),
            "end_ms": parse_clock(side(2), ",."),
            "text": F.array_join(F.transform(payload, lambda x: x["text"]), "\n"),
            "run_on": run_on,
            "head": at(0),
        }
    )
    valid = F.col("token").isNotNull() & F.col("start_ms").isNotNull() & (F.col("end_ms") >= F.col("start_ms")) & (F.size("lines") > 2) & ~F.col("run_on")
    whole = Window.partitionBy("path")
    cues = cues.withColumn("valid", F.min(F.coalesce(valid, F.lit(False))).over(whole)).where("valid")
    blanks = F.length(F.regexp_extract(F.col("head.text"), r"^[ \t]*", 0))
    ordinal = (F.row_number().over(Window.partitionBy("path").orderBy("block")) - 1).cast("int")
    token_at = F.col("head.start") + blanks
    shown = cues.withColumn("ordinal", ordinal).withColumn("visible", visible_markup("text"))
    return shown.select(
        "path", "ordinal", cue_id(F.lit("srt"), F.col("first"), F.col("last"), F.col("ordinal")).alias("cue_id"), "start_ms", "end_ms",
        normalize_display("visible").alias("display_text"), normalize_search("visible").alias("search_text"),
        F.struct(F.col("first").alias("start"), F.col("last").alias("end")).alias("delete_span"),
        F.struct(token_at.alias("start"), (token_at + F.length("token")).alias("end")).alias("index_span"),
    )


def _numeric(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[ \t]*[0-9]+[ \t]*\z"), F.lit(False))
