"""Subtitle files made from cues, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions import format_timestamp
from cuespark.operators.ranking import number_in

HEADERS = {
    "srt": "",
    "webvtt": "WEBVTT\n\n",
    "ass": "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n",
}


def _srt(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), format_timestamp(start, ","), F.lit(" --> "), format_timestamp(end, ","), F.lit("\n"), text, F.lit("\n\n"))


def _vtt(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(format_timestamp(start), F.lit(" --> "), format_timestamp(end), F.lit("\n"), text, F.lit("\n\n"))


def _ass(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("Dialogue: 0,"), format_timestamp(start), F.lit(","), format_timestamp(end), F.lit(",Default,"), F.replace(text, F.lit("\n"), F.lit("\\N")), F.lit("\n"))


_BLOCKS = {"srt": _srt, "webvtt": _vtt, "ass": _ass}
VOLUME = 200_000  # cues of one file: at 300 bytes a cue, what a file may have at most


def render_files(cues: DataFrame, form: str, text: str, extra: Column | None = None, header: str | None = None, bound: DataFrame | None = None) -> DataFrame:
    """``path``, ``body``: a file of each path's cues (``ordinal``, ``start_ms``, ``end_ms``, ``text``) in source order.

    A file takes ``VOLUME`` cues; a path with more continues in further files, whose names have the
    volume's number before the extension, so that no path, however many cues it has, meets in one
    place. ``extra`` is written after each cue, ``header`` in place of the format's own. ``bound`` is that of
    ``number_in``.
    """
    numbered = number_in(cues, "path", ["ordinal", "start_ms", "end_ms", text], "n", bound=bound).withColumn("volume", F.floor((F.col("n") - 1) / VOLUME))
    block = _BLOCKS[form](F.col("n") - F.col("volume") * VOLUME, F.col("start_ms"), F.col("end_ms"), F.col(text))
    block = block if extra is None else F.concat(block, extra)
    listed = numbered.groupBy("path", "volume").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))).alias("blocks"))
    body = F.concat(F.lit(HEADERS[form] if header is None else header), F.array_join(F.transform("blocks", lambda b: b["block"]), ""))
    named = F.when(F.col("volume") == 0, F.col("path")).otherwise(F.regexp_replace("path", r"(?s)^(.*?)(\.[^./]*)?\z", F.concat(F.lit("$1."), F.col("volume").cast("string"), F.lit("$2"))))
    return listed.select(named.alias("path"), body.alias("body"))


def encode_file(body: Column, encoding: str) -> Column:
    """The bytes of a file: utf-8, utf-8-bom, utf-16le-bom or utf-16be-bom."""
    mark, charset = {"utf-8": (b"", "UTF-8"), "utf-8-bom": (b"\xef\xbb\xbf", "UTF-8"), "utf-16le-bom": (b"\xff\xfe", "UTF-16LE"), "utf-16be-bom": (b"\xfe\xff", "UTF-16BE")}[encoding]
    return F.concat(F.lit(mark).cast("binary"), F.encode(body, charset))
