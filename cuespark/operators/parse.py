"""Files with their bytes to cues and failures: one row per file, all of its cues or its first failure."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions import detect_format
from cuespark.kernel.formats import parse
from cuespark.kernel.source import Malformed

SPAN = "struct<start:bigint,end:bigint>"
CUE = f"struct<ordinal:int,cue_id:string,start_ms:bigint,end_ms:bigint,display_text:string,search_text:string,delete_span:{SPAN},index_span:{SPAN}>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ARROW_CUE = pa.struct(
    [
        ("ordinal", pa.int32()), ("cue_id", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()),
        ("display_text", pa.string()), ("search_text", pa.string()), ("delete_span", _SPAN), ("index_span", _SPAN),
    ]
)


def _span(span: tuple[int, int] | None) -> dict | None:
    return None if span is None else {"start": span[0], "end": span[1]}


def located(path: str, line: int, message: str) -> str:
    """A failure's message with its place in front."""
    return f"{path}:{line}: {message}" if line else f"{path}: {message}"


def parsed_row(path: str, form: str, content: bytes) -> dict:
    """``encoding`` and ``cues``, or ``error_line`` and ``error``, of one file."""
    try:
        document = parse(content, form)
    except Malformed as e:
        return {"encoding": None, "cues": None, "error_line": e.line or None, "error": located(path, e.line, e.message)}
    cues = [
        {
            "ordinal": c.ordinal, "cue_id": c.cue_id, "start_ms": c.start_ms, "end_ms": c.end_ms,
            "display_text": c.display_text, "search_text": c.search_text, "delete_span": _span(c.delete_span), "index_span": _span(c.index_span),
        }
        for c in document.cues
    ]
    return {"encoding": document.source.encoding, "cues": cues, "error_line": None, "error": None}


def parse_files(files: DataFrame, path: str = "path", content: str = "content", form: Column | None = None) -> DataFrame:
    """``path``, ``format``, ``encoding``, ``sha256``, ``size``, ``cues``, ``error_line``, ``error`` of each file.

    ``form`` gives the format; without it the path's extension does. A file either has cues (an empty
    array for none) or an error. Files with null bytes, a null path or another extension are errors
    too. Bytes go through the kernel once and don't come back.
    """
    rows = files.select(F.col(path).alias("path"), (detect_format(F.col(path)) if form is None else form).alias("format"), F.col(content).alias("content"))
    rows = rows.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content").cast("bigint")})
    schema = f"path string, format string, encoding string, sha256 string, size bigint, cues array<{CUE}>, error_line int, error string"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for p, f, c in zip(*(batch.column(n).to_pylist() for n in ("path", "format", "content"))):
                made.append(parsed_row(p or "", f or "", c) if c is not None else {"encoding": None, "cues": None, "error_line": None, "error": located(p or "", 0, "file has no content")})
            pick = lambda name, kind: pa.array([m[name] for m in made], kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"), batch.column("format"), pick("encoding", pa.string()), batch.column("sha256"), batch.column("size"),
                    pick("cues", pa.list_(ARROW_CUE)), pick("error_line", pa.int32()), pick("error", pa.string()),
                ],
                ["path", "format", "encoding", "sha256", "size", "cues", "error_line", "error"],
            )

    return rows.mapInArrow(kernel, schema)


def cues_of(parsed: DataFrame) -> DataFrame:
    """One row per cue: ``path``, ``format`` and the cue's fields."""
    return parsed.select("path", "format", F.explode("cues").alias("cue")).select("path", "format", "cue.*")


def issues_of(parsed: DataFrame) -> DataFrame:
    """The files that couldn't be parsed: ``path``, ``kind`` (invalid), ``size``, ``error_line``, ``error``."""
    return parsed.where("error is not null").select("path", F.lit("invalid").alias("kind"), "size", "error_line", "error")
