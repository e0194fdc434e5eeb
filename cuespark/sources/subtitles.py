"""The ``subtitles`` data source: files below a root, each read and parsed once, or the reason why not.

Options: ``root`` (or the load path), ``file`` (one relative path instead of the tree), ``content`` (true
to keep the bytes), ``maxFileSize``, ``partitions``, ``listing`` (true to list the entries without reading
them), ``log`` (where a stream keeps what it has seen). A row is a file (``issue`` null) with its cues, or
an issue.

Directories are expanded breadth first on the driver only until there are enough of them to share
out; every task then walks its own part of the tree. Links are never followed. Rows leave Python as
Arrow batches. A scan (``operators.discovery``) first lists the tree this way and then reads the
entries in parts of alike size, however many that takes.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from cuespark.kernel import files as K
from cuespark.kernel.formats import detect_format
from cuespark.operators.parse import ARROW_CUE, CUE, parsed_row

SCHEMA = (
    "path string, issue string, format string, encoding string, size bigint, mode int, mtime timestamp, sha256 string, "
    f"identity struct<kind:string,volume:decimal(20,0),object:decimal(20,0)>, cues array<{CUE}>, error_line int, error string, content binary"
)
COLUMNS = ("path", "issue", "format", "encoding", "size", "mode", "mtime", "sha256", "identity", "cues", "error_line", "error", "content")


@dataclass
class Part(InputPartition):
    """What one task reads: whole subtrees and single entries."""

    trees: list[str]
    entries: list[K.Found]

    def __init__(self, trees: list[str], entries: list[K.Found]):
        super().__init__(0)
        self.trees, self.entries = trees, entries


_IDENTITY = pa.struct([("kind", pa.string()), ("volume", pa.decimal128(20, 0)), ("object", pa.decimal128(20, 0))])
KINDS = (
    pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.timestamp("us", "UTC"), pa.string(), _IDENTITY, pa.list_(ARROW_CUE), pa.int32(), pa.string(), pa.binary(),
)
BATCH_FILES, BATCH_BYTES = 1_000, 16 << 20  # of files that leave together


def checked_name(found: K.Found) -> K.Found:
    """The entry; one whose name is no text is unsafe, and shown with U+FFFD."""
    shown = found.path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return found if shown == found.path else K.Found(shown, found.size, "unsafe", "name is no UTF-8")


def load_entry(root: str, found: K.Found, keep: bool, most: int) -> dict:
    """The row of one entry: read safely and parsed, or its issue."""
    found = checked_name(found)
    form = detect_format(found.path)
    head = {"path": found.path, "format": form}
    if found.kind:
        return head | {"issue": found.kind, "size": found.size, "error": f"{found.path}: {found.message}"}
    try:
        got = K.read_safe(root, found.path, most=most)
    except K.FileProblem as e:
        kind = e.kind if e.kind in ("hardlink", "unsafe") else "unreadable"
        return head | {"issue": kind, "size": found.size, "error": f"{found.path}: {e.message}"}
    except OSError as e:
        return head | {"issue": "unreadable", "size": found.size, "error": f"{found.path}: {e.strerror}"}
    parsed = parsed_row(found.path, form, got.data)
    if parsed["error"]:
        return head | {"issue": "invalid", "size": got.size, "error_line": parsed["error_line"], "error": parsed["error"]}
    kind, volume, number = got.identity
    return head | {
        "encoding": parsed["encoding"], "size": got.size, "mode": got.mode, "mtime": datetime.fromtimestamp(got.mtime_ns / 1e9, UTC), "sha256": got.sha256,
        "identity": {"kind": kind, "volume": Decimal(volume), "object": Decimal(number)}, "cues": parsed["cues"], "content": got.data if keep else None,
    }


def batched(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    waiting: list[dict] = []
    size = 0
    for row in rows:
        waiting.append(row)
        size += row.get("size") or 0
        if len(waiting) >= BATCH_FILES or size >= BATCH_BYTES:
            yield _batch(waiting)
            waiting, size = [], 0
    if waiting:
        yield _batch(waiting)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(COLUMNS, KINDS)], list(COLUMNS))


def load_listed(entries: DataFrame, root: str, keep: bool, most: int = K.MOST_BYTES) -> DataFrame:
    """The rows of listed entries (``path``, ``size``, ``issue``, ``error``), read where they are."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for path, size, issue, error in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "issue", "error"))):
                    yield {"path": path, "format": detect_format(path), "issue": issue, "size": size, "error": error} if issue else load_entry(root, K.Found(path, size), keep, most)

        return batched(rows())

    return entries.select("path", "size", "issue", "error").mapInArrow(kernel, SCHEMA)


class _Settings:
    def __init__(self, options: dict):
        self.root = options.get("root") or options.get("path") or ""
        if not self.root or not os.path.isdir(self.root):
            raise ValueError(f"root is no directory: {self.root!r}")
        self.root = os.path.realpath(self.root)
        self.file = options.get("file")
        self.keep = str(options.get("content", "false")).lower() == "true"
        self.most = int(options.get("maxfilesize", options.get("maxFileSize", K.MOST_BYTES)))
        self.parts = int(options.get("partitions", 64))
        self.listing = str(options.get("listing", "false")).lower() == "true"
        self.log = options.get("log") or os.path.join(self.root, ".cuespark-stream")

    def plan(self) -> list[Part]:
        if self.file is not None:
            if not K.safe_relative(self.file):
                raise ValueError(f"unsafe path {self.file!r}")
            if not detect_format(self.file):
                raise ValueError(f"unsupported subtitle format: {self.file!r}")
            return [Part([], [K.look(self.root, self.file, self.most)])]
        trees, entries = [""], []
        while trees and len(trees) < self.parts:
            below = []
            for tree in trees:
                for x in K.walk(self.root, tree, self.most, deep=False):
                    (below if isinstance(x, str) else entries).append(x)
            if not below:
                trees = []
                break
            trees = below
        count = max(1, min(self.parts, len(trees) + len(entries)))
        entries.sort(key=lambda f: -(f.size or 0))  # large files first, so that the parts get alike
        return [Part(trees[i::count], entries[i::count]) for i in range(count)]

    def found(self, part: Part) -> Iterator[K.Found]:
        for tree in part.trees:
            yield from K.walk(self.root, tree, self.most)
        yield from part.entries

    def rows(self, part: Part) -> Iterator[dict]:
        for found in map(checked_name, self.found(part)):
            if not self.listing:
                yield load_entry(self.root, found, self.keep, self.most)
            else:
                error = f"{found.path}: {found.message}" if found.kind else None
                yield {"path": found.path, "format": detect_format(found.path), "issue": found.kind, "size": found.size, "error": error}


class SubtitleReader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[Part]:
        return self.settings.plan()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batched(self.settings.rows(partition))


class SubtitleStream(DataSourceStreamReader):
    """New and changed files, micro-batch by micro-batch.

    An offset names a snapshot by its digest, so its size doesn't depend on the tree. The snapshots,
    the names and versions of all files, are kept in the ``log`` folder, until a later one is committed.
    """

    def __init__(self, settings: _Settings):
        self.settings = settings

    def _snapshot(self) -> dict[str, str]:
        seen = {}
        for found in K.walk(self.settings.root, "", self.settings.most):
            if found.kind is None:
                try:
                    info = os.lstat(os.path.join(self.settings.root, found.path))
                except FileNotFoundError:
                    continue
                seen[found.path] = f"{info.st_dev}:{info.st_ino}:{info.st_mtime_ns}:{info.st_size}"
        return seen

    def _at(self, name: str) -> str:
        return os.path.join(self.settings.log, f"{name}.json.gz")

    def _load(self, offset: dict) -> dict[str, str]:
        if not offset["snapshot"]:
            return {}
        with gzip.open(self._at(offset["snapshot"]), "rt", encoding="utf-8", errors="surrogateescape") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"snapshot": ""}

    def latestOffset(self) -> dict:
        seen = self._snapshot()
        if not seen:
            return self.initialOffset()
        text = json.dumps(seen, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()
        if not os.path.exists(self._at(name)):
            os.makedirs(self.settings.log, mode=0o700, exist_ok=True)
            K.write_durably(self.settings.log, f"{name}.json.gz", gzip.compress(text.encode()))
        return {"snapshot": name}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        old, new = self._load(start), self._load(end)
        fresh = [K.Found(p, None) for p in sorted(new) if old.get(p) != new[p]]
        count = max(1, min(self.settings.parts, len(fresh)))
        return [Part([], fresh[i::count]) for i in range(count)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return batched(self.settings.rows(partition))

    def commit(self, end: dict) -> None:
        """Snapshots that are older than the committed one are no offset any more."""
        with contextlib.suppress(OSError):
            kept = os.stat(self._at(end["snapshot"])).st_mtime_ns
            for entry in os.scandir(self.settings.log):
                if entry.name.endswith(".json.gz") and entry.stat().st_mtime_ns < kept:
                    os.unlink(entry.path)


class SubtitleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "subtitles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SubtitleReader(_Settings(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SubtitleStream(_Settings(dict(self.options)))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("subtitles")`` and ``spark.readStream.format("subtitles")`` work.

    The processes that plan a stream don't see the files of an application, so the source is sent
    with all it needs.
    """
    import cuespark

    cloudpickle.register_pickle_by_value(cuespark)
    try:
        spark.dataSource.register(SubtitleSource)
    finally:
        cloudpickle.unregister_pickle_by_value(cuespark)
