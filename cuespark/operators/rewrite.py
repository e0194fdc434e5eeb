"""Rendering of files without the planned cues."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.kernel.formats import parse
from cuespark.kernel.rewrite import delete_cues, validate_deletion
from cuespark.kernel.source import Malformed

RENDERED = "path string, format string, rendered binary, post_sha256 string, deleted_cues int, changed boolean, valid boolean, error string"


def _render(content: bytes, form: str, ids: list[str]) -> tuple:
    try:
        document = parse(content, form)
        new = delete_cues(content, document, ids)
        fault = validate_deletion(content, document, ids, new)
    except Malformed as e:
        return None, None, 0, False, False, e.message
    return new, hashlib.sha256(new).hexdigest(), len(ids), new != content, fault is None, fault


def render_deletion(files: DataFrame, plan: DataFrame) -> DataFrame:
    """``path``, ``format``, ``rendered``, ``post_sha256``, ``deleted_cues``, ``changed``, ``valid``, ``error`` per planned file.

    ``files`` has ``path``, ``format`` and ``content``, ``plan`` has ``path`` and ``cue_ids``. An empty list
    leaves the bytes as they are; repeated ids delete once but count as asked; an unknown id or a
    file that doesn't parse is an error. Each result is parsed again before it is called valid.
    """
    rows = plan.select("path", "cue_ids").join(files.select("path", "format", "content"), "path").select("path", "format", "content", "cue_ids")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            for at in range(batch.num_rows):  # one file at a time: a file may have tens of megabytes
                one = batch.slice(at, 1)
                made = _render(one.column("content")[0].as_py(), one.column("format")[0].as_py(), one.column("cue_ids")[0].as_py() or [])
                yield pa.RecordBatch.from_arrays(
                    [one.column("path"), one.column("format"), *(pa.array([v], k) for v, k in zip(made, kinds))],
                    ["path", "format", "rendered", "post_sha256", "deleted_cues", "changed", "valid", "error"],
                )

    return rows.mapInArrow(kernel, RENDERED)


def splice_out(content: Column, spans: Column) -> Column:
    """``content`` without sorted, disjoint byte ranges, in built-in expressions.

    The kept pieces are those before each range and after the last one; for files without numbers to
    renew (WebVTT, ASS) this is the whole deletion.
    """
    size = F.octet_length(content).cast("bigint")
    zero = F.lit(0).cast("bigint")
    begins = F.concat(F.array(zero), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(size))
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(content, (b + 1).cast("int"), (e - b).cast("int")))
    return F.aggregate(pieces, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x))
