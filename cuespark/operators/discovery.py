"""Scans: files, issues and cues of a directory tree, as one pinned snapshot."""

from __future__ import annotations

import contextlib
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.functions import normalize_search
from cuespark.shared import checkpointed, snapshot
from cuespark.ship import ship
from cuespark.sources import register
from cuespark.sources.subtitles import load_listed

PART_BYTES, PART_FILES = 64 << 20, 10_000  # of the files that one task reads, about


@dataclass(frozen=True)
class Discovery:
    """A scan. A supported file is either in ``files`` or in ``issues``; ``revision`` grows with every scan."""

    root: str
    revision: int
    scanned: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.scanned.where("issue is null").select("path", "format", "encoding", "size", "mode", "mtime", "sha256", "identity", F.size("cues").alias("cue_count"), "content")

    @property
    def issues(self) -> DataFrame:
        return self.scanned.where("issue is not null").select("path", F.col("issue").alias("kind"), "size", "error_line", "error")

    @property
    def cues(self) -> DataFrame:
        return self.scanned.where("issue is null").select("path", "format", F.explode("cues").alias("c")).select("path", "format", "c.*")


def discover(spark: SparkSession, root: str, revision: int = 1, file: str | None = None, content: bool = False, progress: Callable[[int, int], None] | None = None) -> Discovery:
    """Scans a tree, or one file of it. The result is written once, so later changes of the files don't show in it.

    ``progress`` is told now and then, and at the end, how many of how many parts of the tree are done.
    """
    register(ship(spark))
    reader = spark.read.format("subtitles").option("root", root).option("content", str(content).lower())
    with _told(spark, progress):
        if file is not None:
            return Discovery(root, revision, snapshot(reader.option("file", file).load()))
        parts = max(64, 4 * spark.sparkContext.defaultParallelism)
        listed = checkpointed(reader.option("listing", "true").option("partitions", str(parts)).load().select("path", "size", "issue", "error"))
        total = listed.where("issue is null").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        # parts of alike size, at least one a task slot
        count = max(-(-total["size"] // PART_BYTES), -(-total["files"] // PART_FILES), min(total["files"], spark.sparkContext.defaultParallelism), 1)
        return Discovery(root, revision, snapshot(load_listed(listed.repartition(count, "path"), os.path.realpath(root), content)))


@contextlib.contextmanager
def _told(spark: SparkSession, progress: Callable[[int, int], None] | None, every: float = 0.2) -> Iterator[None]:
    if progress is None:
        yield
        return
    context, group, over = spark.sparkContext, f"scan-{uuid.uuid4().hex}", threading.Event()
    tracker = context.statusTracker()

    def count() -> tuple[int, int]:
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def watch() -> None:
        said = None
        while not over.wait(every):
            if (now := count()) != said and now[1]:
                progress(*now)
                said = now

    watcher = threading.Thread(target=watch, daemon=True)
    context.setJobGroup(group, "scan of a tree")
    watcher.start()
    try:
        yield
    finally:
        over.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", None)
    total = count()[1]
    progress(total, total)


def by_folded_path(frame: DataFrame) -> DataFrame:
    """Output order of files and issues: case-folded path, then path."""
    return frame.orderBy(normalize_search("path"), "path")


def cards(found: Discovery) -> DataFrame:
    """Files and issues together, in the order of lists: lower-case path, then path."""
    files = found.files.select("path", "format", "size", "cue_count")
    return files.unionByName(found.issues.select("path", "kind", "size", "error"), allowMissingColumns=True).orderBy(F.lower("path"), "path")
