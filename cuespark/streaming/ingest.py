"""Streams: new files of a tree, matches in them, and windowed counts of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.operators.search import search_any
from cuespark.sources import register


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream with a row for each new or changed file below ``root``: its cues, or its issue."""
    register(spark)
    return spark.readStream.format("subtitles").option("root", root).load()


def match_stream(files: DataFrame, phrases: list[str]) -> DataFrame:
    """The matching cues of a stream of files, as they arrive."""
    cues = files.where("issue is null").select("path", "format", F.explode("cues").alias("c")).select("path", "format", "c.*")
    return search_any(cues, phrases)


def windowed_counts(scans: DataFrame, time: str, late: str, width: str, key: str) -> DataFrame:
    """Rows per tumbling window and key of a stream, emitted once a window can get no more rows."""
    return scans.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("rows"))
