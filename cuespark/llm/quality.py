"""Statistics of document texts that tell natural speech from lists, tables and junk."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.spoken import TIMED, spoken_line, spoken_lines
from cuespark.shared import checkpointed

CHUNK = 65_536  # bytes of a document that are counted at once
FAN_IN = 64  # partial states that one step of the tree merges
LONGEST = 1 << 31  # bytes that a text can have at most
ENDINGS = (".", "!", "?", "…")
MOST_COMMON_WORDS = 1_000_000
_SYMBOLS = re.compile(r"[\W_]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
COUNTS = ("tokens", "token_chars", "symbols", "lines", "ended", "common")


class Counter:
    """Counts of spoken lines: tokens, their characters, symbols among them, lines, ended lines, common tokens."""

    def __init__(self, common: dict[str, set[str]]):
        self.common, self.every = common, set().union(*common.values()) if common else set()
        self.known: dict[str | None, dict[str, bool]] = {}

    def _is_common(self, known: dict[str, bool], vocabulary: set[str], token: str) -> bool:
        low = token.lower()
        bare = low if low.isalnum() else _EDGES.sub("", low).replace("’", "'")
        if len(known) > 300_000:
            known.clear()
        known[token] = hit = bare in vocabulary
        return hit

    def count(self, lines: list[str], lang: str | None) -> list[int]:
        tokens = " ".join(lines).split()
        joined = "".join(tokens)
        known = self.known.setdefault(lang, {})
        vocabulary = self.every if lang is None else self.common.get(lang, set())
        common = 0
        for t in tokens:
            hit = known.get(t)
            common += self._is_common(known, vocabulary, t) if hit is None else hit
        return [len(tokens), len(joined), len(joined) - len(_SYMBOLS.sub("", joined)), len(lines), sum(x.endswith(ENDINGS) for x in lines), common]


STATE = ", ".join(f"{c} bigint" for c in COUNTS)
EDGE = "struct<chunk:int,last:int,head:binary,tail:binary,broken:boolean>"
KEYS = ("doc_id", "format", "lang", "copy")
_EDGE = pa.struct([("chunk", pa.int32()), ("last", pa.int32()), ("head", pa.binary()), ("tail", pa.binary()), ("broken", pa.bool_())])


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _count_whole(common: dict[str, set[str]]):
    """The counts of the documents of one chunk; the chunks of longer ones pass as they are."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(common)
        for batch in batches:
            whole = batch.column("chunks").to_pylist()
            texts = batch.column("piece")
            counts = [
                counter.count(spoken_lines(_text(texts[i].as_py()), form), lang) if whole[i] == 1 else [0] * len(COUNTS)
                for i, (form, lang) in enumerate(zip(batch.column("format").to_pylist(), batch.column("lang").to_pylist()))
            ]
            left = pa.compute.if_else(pa.array([w > 1 for w in whole]), texts, pa.nulls(len(whole), pa.binary()))
            kept = [batch.column(c) for c in (*KEYS, "chunks", "chunk")]
            yield pa.RecordBatch.from_arrays([*kept, left, *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS)))], [*KEYS, "chunks", "chunk", "piece", *COUNTS])

    import pyarrow.compute  # noqa: F401

    return kernel


def _count_pieces(common: dict[str, set[str]]):
    """The state of each chunk of a longer document: counts of its whole lines, and the parts of lines at its two ends."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(common)
        for batch in batches:
            counts = [list(row) for row in zip(*(batch.column(c).to_pylist() for c in COUNTS))]
            edges: list[dict | None] = [None] * batch.num_rows
            pieces = batch.column("piece")
            for i in np.flatnonzero(pieces.is_valid().to_numpy(zero_copy_only=False)).tolist():
                form, lang, n = (batch.column(c)[i].as_py() for c in ("format", "lang", "chunk"))
                head, *rest = pieces[i].as_py().split(b"\n")
                tail = rest.pop() if rest else None
                counts[i] = counter.count([x for x in (spoken_line(_text(y), form in TIMED) for y in rest) if x], lang)
                edges[i] = {"chunk": n, "last": n, "head": head, "tail": tail, "broken": tail is not None}
            kept = [batch.column(c) for c in (*KEYS, "chunks", "chunk")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))), pa.array(edges, _EDGE)], [*KEYS, "chunks", "chunk", *COUNTS, "edge"])

    return kernel


def merge_edges(edges: list[dict]) -> tuple[dict, list[str]]:
    """The edge of neighbouring chunks taken together, and the lines that became whole between them. Associative."""
    edges = sorted(edges, key=lambda e: e["chunk"])
    head, open_, whole = [edges[0]["head"]], [edges[0]["tail"]] if edges[0]["broken"] else None, []
    for e in edges[1:]:
        part = head if open_ is None else open_
        part.append(e["head"])
        if e["broken"]:
            if open_ is not None:
                whole.append(b"".join(open_))
            open_ = [e["tail"]]
    return {
        "chunk": edges[0]["chunk"], "last": edges[-1]["last"], "head": b"".join(head),
        "tail": None if open_ is None else b"".join(open_), "broken": open_ is not None,
    }, whole


def _merge(common: dict[str, set[str]], final: bool):
    """Merged states: the counts are summed already, what the edges give is added; at the end, the edges themselves."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(common)
        for batch in batches:
            groups = batch.column("edges").to_pylist()
            extra = [[0] * batch.num_rows for _ in COUNTS]
            merged: list[dict | None] = []
            for r, edges in enumerate(groups):
                edge = None
                if edges:
                    form, lang = batch.column("format")[r].as_py(), batch.column("lang")[r].as_py()
                    edge, lines = merge_edges(edges)
                    timed = form in TIMED
                    spoken = [spoken_line(_text(x), timed) for x in lines]
                    if final:
                        spoken.append(spoken_line(_text(edge["head"]), timed, True))
                        if edge["broken"]:
                            spoken.append(spoken_line(_text(edge["tail"]), timed))
                        edge = None
                    for i, n in enumerate(counter.count([x for x in spoken if x], lang)):
                        extra[i][r] = n
                merged.append(edge)
            arrays = [pa.compute.add(batch.column(c), pa.array(x, pa.int64())) for c, x in zip(COUNTS, extra)]
            kept = [batch.column(c) for c in (*KEYS, "chunk", "times")]
            yield pa.RecordBatch.from_arrays([*kept, *arrays, pa.array(merged, _EDGE)], [*KEYS, "chunk", "times", *COUNTS, "edge"])

    import pyarrow.compute  # noqa: F401

    return kernel


def collect_common_words(table: DataFrame) -> dict[str, set[str]]:
    """The common words (``lang``, ``word``) by language, for the driver; too many are refused, never cut."""
    rows = table.where("lang is not null and word is not null").select("lang", "word").limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"more than {MOST_COMMON_WORDS} common words")
    out: dict[str, set[str]] = {}
    for lang, word in rows:
        out.setdefault(lang, set()).add(word)
    return out


def text_statistics(documents: DataFrame, doc_id: str, text: str, lang: str, document_format: str, common: dict[str, set[str]], chunk: int = CHUNK) -> DataFrame:
    """Counts and ratios of the spoken lines of each document with a text, and the rules they break.

    Result: ``doc_id``, the counts ``tokens``, ``token_chars``, ``symbols`` (characters in tokens, neither
    letters nor digits), ``lines``, ``ended`` (lines ending in a sentence mark), ``common`` (tokens among
    the common words of the language, of any language if it is null), the ratios ``mean_length``,
    ``symbol_share``, ``ended_share``, ``common_share`` (null where there is nothing to divide by), and
    ``broken``, the names of the rules that hold: few_tokens, token_length, symbols, endings, common.

    A document is cut into chunks of ``chunk`` bytes, each copied from its place without reading the rest; a
    character that a border cuts is put together with its line. Chunks of longer documents are dealt to all tasks, and so counted beside each other; a document of one chunk
    is counted where it is. The state of a chunk is the counts of its whole lines and the parts of
    lines at its ends; states merge associatively, ``FAN_IN`` at a time, in as many steps as the
    longest possible text needs, and the lines that become whole at the borders are counted then. A
    state is as large as two part lines: what must fit in one task is the longest line, not the text.

    Defined results: documents with a null text have no row; empty ones have zero counts and break
    the rules of few tokens. Each row is a document of its own, with a row in the result, also where
    ids or whole rows repeat (long texts of one id are told apart by a hash). Null ids are fine.
    """
    kind = dict(documents.dtypes)[doc_id]
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(document_format).alias("format"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("text is not null")
    size = F.octet_length("text")
    many = F.floor((F.greatest(size, F.lit(1)) - 1) / chunk).cast("int") + 1
    raw = F.col("text").cast("binary")
    # the bytes are an argument of the outer function, so that they are made once and not for every piece
    slices = F.transform(F.array(raw), lambda whole: F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(whole, i * chunk + 1, F.lit(chunk))))
    pieces = F.when(size <= chunk, F.array(raw)).otherwise(F.get(slices, F.lit(0)))
    rows = rows.select("doc_id", "format", "lang", F.when(size > chunk, F.xxhash64("text")).alias("copy"), many.alias("chunks"), pieces.alias("pieces"))
    rows = rows.select(*KEYS, "chunks", F.posexplode("pieces").alias("chunk", "piece"))  # on its own: else the whole text goes along with every piece
    key_types = f"doc_id {kind}, format string, lang string, copy bigint"
    whole = rows.mapInArrow(_count_whole(common), f"{key_types}, chunks int, chunk int, piece binary, {STATE}")
    # a fixed number of parts: pieces compress well but take long to count, so they aren't put together by size
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = whole.repartition(parts, "doc_id", "copy", "chunk").mapInArrow(_count_pieces(common), f"{key_types}, chunks int, chunk int, {STATE}, edge {EDGE}")
    states = checkpointed(states)  # small, and read for the short and for the long documents
    short = states.where("chunks = 1").select("doc_id", *COUNTS)
    # equal rows have equal chunks: each is taken once, with the number of rows
    parts = states.where("chunks > 1").groupBy(*KEYS, "chunk").agg(F.first(F.struct(*COUNTS, "edge")).alias("state"), F.count(F.lit(1)).alias("times"))
    parts = parts.select(*KEYS, "chunk", "times", "state.*")
    schema = f"{key_types}, chunk int, times bigint, {STATE}, edge {EDGE}"
    left = -(-LONGEST // chunk)
    while left > 1:
        left = -(-left // FAN_IN)
        parts = (
            parts.groupBy(*KEYS, F.floor(F.col("chunk") / FAN_IN).cast("int").alias("part"))
            .agg(F.max("times").alias("times"), *[F.sum(c).alias(c) for c in COUNTS], F.collect_list("edge").alias("edges"))
            .withColumnRenamed("part", "chunk")
            .mapInArrow(_merge(common, left == 1), schema)
        )
    merged = parts.select("doc_id", *COUNTS, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("row")).drop("row")
    states = short.unionAll(merged)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = states.withColumns(
        {"mean_length": ratio("token_chars", "tokens"), "symbol_share": ratio("symbols", "token_chars"), "ended_share": ratio("ended", "lines"), "common_share": ratio("common", "tokens")}
    )
    rules = {
        "few_tokens": F.col("tokens") < 20,
        "token_length": (F.col("mean_length") < 2.5) | (F.col("mean_length") > 9),
        "symbols": F.col("symbol_share") > 0.25,
        "endings": F.col("ended_share") < 0.25,
        "common": F.col("common_share") < 0.1,
    }
    return out.withColumn("broken", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
