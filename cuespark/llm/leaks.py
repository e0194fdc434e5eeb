"""Passages of evaluation texts inside documents, found by spaced seeds."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.spoken import spoken_lines, words
from cuespark.shared import checkpointed

LEAST_WORDS = 12
# Which word positions of a window a seed compares: within LEAST_WORDS equal words any seed of that length matches.
EXACT_SEEDS = ("110110110110",)
# Every stretch of LEAST_WORDS equal words with at most one other word between neighbouring ones holds one
# of these, wherever the other words stand: there are 2,048 such stretches, and the tests go through all.
NEAR_SEEDS = ("101101010101", "101010101101", "1010010110101", "100010101010101", "1010010101101", "1101101101", "100011011011")
MOST_SEEDS = 16
MOST_SENT = 4_000_000  # characters of evaluation text whose windows are sent to the documents: at most 32 MB a seed
DOCUMENTS_AT_ONCE = 512
FILTER_BITS = 27  # the windows of larger evaluation sets are known to the documents by a bitmap of 16 MB
GROUP = 4_096  # diagonals of a document that are compared in one row
NAMES = 1 << 20  # by that many hashes the documents with hits are picked out

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xBF58476D1CE4E5B9)


def seeds_for(substitutions: int, least: int = LEAST_WORDS) -> tuple[str, ...]:
    """Seeds of which every stretch that ``_overlaps`` reports holds one at least."""
    if least >= LEAST_WORDS and substitutions <= 1:
        # every seed lies within a run of LEAST_WORDS equal words: one is enough
        return NEAR_SEEDS if substitutions else EXACT_SEEDS
    # all ways in which the first equal words of a stretch can stand, for as many words as MOST_SEEDS allow
    weight = 1
    while weight < min(least, LEAST_WORDS) and (substitutions + 1) ** weight <= MOST_SEEDS:
        weight += 1
    return tuple("1" + "".join("0" * gap + "1" for gap in gaps) for gaps in itertools.product(range(substitutions + 1), repeat=weight - 1))


class _Words:
    """Numbers for words: the same word has the same 64-bit number everywhere."""

    def __init__(self):
        self.numbers: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        get = self.numbers.get
        out = [get(w) for w in found]
        if None in out:
            if len(self.numbers) > 1_000_000:
                self.numbers.clear()
            for i, n in enumerate(out):
                if n is None:
                    w = found[i]
                    out[i] = self.numbers[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array(out, dtype=np.uint64)


def _windows(numbers: np.ndarray, seed: str) -> np.ndarray:
    """The hash of each window of len(seed) words, over the positions the seed compares."""
    n = len(numbers) - len(seed) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(seed):
            if bit == "1":
                x = (out ^ numbers[i : i + n]) * _MIX
                out = (x ^ (x >> np.uint64(29))) * _TURN + np.uint64(i)
    return out


PREFIX = 20


class EvaluationIndex:
    """The windows of evaluation items, by seed, sorted by hash; and which first bits of a hash occur."""

    def __init__(self, ids: pa.ChunkedArray, texts: list[str], seeds: tuple[str, ...]):
        number = _Words()
        self.seeds, self.ids, self.tokens = seeds, pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type), [number(words(t)) for t in texts]
        self.tables = []
        for seed in seeds:
            parts = [_windows(t, seed) for t in self.tokens]
            hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            at = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.empty(0, np.int64)
            order = np.argsort(hashes, kind="stable")
            begun = np.zeros(1 << PREFIX, bool)
            begun[(hashes >> np.uint64(64 - PREFIX)).astype(np.int64)] = True
            self.tables.append((hashes[order], item[order].astype(np.int32), at[order].astype(np.int32), begun))

    def hits(self, numbers: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``numbers``, item, position in the item) of all windows with equal hashes."""
        hashes, item, at, begun = self.tables[seed]
        own = _windows(numbers, self.seeds[seed])
        near = np.flatnonzero(begun[(own >> np.uint64(64 - PREFIX)).astype(np.int64)])
        low, high = np.searchsorted(hashes, own[near], "left"), np.searchsorted(hashes, own[near], "right")
        count = high - low
        where = np.repeat(near, count)
        rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pick = np.repeat(low, count) + rank
        return where, item[pick], at[pick]


def _overlaps(document: np.ndarray, item: np.ndarray, shift: int, substitutions: int, least: int) -> list[tuple[int, int, int, int]]:
    """The stretches of one diagonal: (first position in the document, length, words that differ, longest run of equal words).

    A stretch begins and ends with equal words, and between two neighbouring equal words at most
    ``substitutions`` words differ; it has ``least`` equal words at least. Zero gives exact runs.
    """
    first = max(0, shift)
    last = min(len(document), len(item) + shift)
    same = np.flatnonzero(document[first:last] == item[first - shift : last - shift])
    if len(same) < least:
        return []
    steps = np.diff(same)
    cut = np.flatnonzero(steps > substitutions + 1)
    starts, ends = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(same) - 1]))
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        length, equal = int(same[b] - same[a] + 1), b - a + 1
        if equal >= least:
            breaks = np.flatnonzero(steps[a:b] > 1)
            run = int(np.diff(np.concatenate(([-1], breaks, [equal - 1]))).max())
            out.append((first + int(same[a]), length, length - equal, run))
    return out


FOUND = "doc_word bigint, item_word bigint, words bigint, substituted bigint, run bigint"
COLUMNS = ["doc_id", "item_id", "doc_word", "item_word", "words", "substituted", "run"]


def _document_words(batch: pa.RecordBatch, text: int, form: int) -> list[list[str]]:
    texts, formats = batch.column(text).to_pylist(), batch.column(form).to_pylist()
    return [words(" ".join(spoken_lines(t, f))) if t is not None else [] for t, f in zip(texts, formats)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
            yield whole.slice(begin, DOCUMENTS_AT_ONCE)


def _rows_of(windows: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each window of joined rows that end at ``ends``, and which windows lie within their row."""
    row = np.searchsorted(ends, windows, "right")
    return row, windows + span <= ends[row] if len(windows) else np.empty(0, bool)


def _in_place(shared, substitutions: int, least: int) -> Callable:
    """The hashes are joined where the documents are, against an index that has been sent."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, index = _Words(), shared.value
        for batch in _slices(batches):
            found = _document_words(batch, 1, 2)
            sizes = np.array([len(x) for x in found], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            numbers = number([w for x in found for w in x])
            diagonals: set[tuple[int, int, int]] = set()
            for seed in range(len(index.seeds)):
                where, item, at = index.hits(numbers, seed)
                row, fits = _rows_of(where, ends, len(index.seeds[seed]))
                row, item, shift = row[fits], item[fits], where[fits] - starts[row[fits]] - at[fits]
                diagonals.update(zip(row.tolist(), item.tolist(), shift.tolist()))
            out: list[tuple] = []
            for r, i, shift in sorted(diagonals):
                own = numbers[starts[r] : ends[r]]
                out += [(r, i, p, p - shift, *rest) for p, *rest in _overlaps(own, index.tokens[i], shift, substitutions, least)]
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), index.ids.take(pa.array(cols[1], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[2:])], COLUMNS
            )

    return kernel


def _item_windows(seeds: tuple[str, ...]) -> Callable:
    """(item, hash, at) of every window of the items, and their words as numbers in ``at`` = -1."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Words()
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                numbers = number(words(text))
                parts = [_windows(numbers, s) ^ np.uint64(k) for k, s in enumerate(seeds)]
                hashes = np.concatenate(parts)
                at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts])
                hashes, at = pa.array(np.append(hashes, np.uint64(0)).view(np.int64)), pa.array(np.append(at, np.int32(-1)), pa.int32())
                own = pa.array([None] * (len(at) - 1) + [numbers.view(np.int64).tolist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(at))), hashes, at, own], ["item", "hash", "at", "numbers"])

    return kernel


def _hits(bitmap, seeds: tuple[str, ...]) -> Callable:
    """(doc_id, hash, word) of the windows of documents whose hash the bitmap knows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = _Words(), bitmap.value
        for batch in _slices(batches):
            found = _document_words(batch, 1, 2)
            sizes = np.array([len(x) for x in found], np.int64)
            ends = np.cumsum(sizes)
            numbers = number([w for x in found for w in x])
            for k, seed in enumerate(seeds):
                hashes = _windows(numbers, seed) ^ np.uint64(k)
                bit = (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                at = np.flatnonzero((known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                row, fits = _rows_of(at, ends, len(seed))
                row, at = row[fits], at[fits]
                word = at - (ends - sizes)[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(hashes[at].view(np.int64)), pa.array(word, pa.int64())], ["doc_id", "hash", "word"])

    return kernel


def _compare(substitutions: int, least: int) -> Callable:
    """The stretches on the diagonals of a document: (doc_id, text, format, diagonals)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Words()
        for batch in _slices(batches):
            out: list[tuple] = []
            for r, found in enumerate(_document_words(batch, 1, 2)):
                own = number(found)
                for d in batch.column(3)[r].as_py():
                    item = np.array(d["numbers"], np.int64).view(np.uint64)
                    out += [(r, d["item_id"], p, p - d["shift"], *rest) for p, *rest in _overlaps(own, item, d["shift"], substitutions, least)]
            cols = list(zip(*out)) if out else [()] * 7
            kind = batch.schema.field(3).type.value_type.field("item_id").type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kind), *(pa.array(c, pa.int64()) for c in cols[2:])], COLUMNS)

    return kernel


def _bitmap(hashes: DataFrame, hash_: Column) -> np.ndarray:
    """Which of the last ``FILTER_BITS`` bits of the hashes occur: 2^(FILTER_BITS - 3) bytes, whatever the number of hashes."""
    bit = hash_.bitwiseAND((1 << FILTER_BITS) - 1)
    parts = hashes.groupBy(F.floor(bit / 32_768).alias("part")).agg(F.bitmap_construct_agg(bit % 32_768).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for part, bits in parts:
        out[part * 4_096 : (part + 1) * 4_096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _by_shuffle(part: DataFrame, items: DataFrame, seeds: tuple[str, ...], substitutions: int, least: int) -> DataFrame:
    """Hashes of both sides joined by shuffle: for evaluation sets that are too large to be sent."""
    kind, item_kind = part.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    named = items.select(F.struct("item_id", F.xxhash64("text").alias("copy")).alias("item"), "text")
    windows = checkpointed(named.mapInArrow(_item_windows(seeds), f"item struct<item_id:{item_kind},copy:bigint>, hash bigint, at int, numbers array<bigint>"))
    seen = windows.where("at >= 0").select("item", "hash", "at")
    shared = part.sparkSession.sparkContext.broadcast(_bitmap(seen, F.col("hash")))  # 16 MB
    hits = part.mapInArrow(_hits(shared, seeds), f"doc_id {kind}, hash bigint, word bigint")
    diagonals = checkpointed(hits.join(seen, "hash").select("doc_id", "item", (F.col("word") - F.col("at")).alias("shift")).distinct())
    # a document's diagonals are dealt to groups: none grows with the document
    groups = diagonals.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups")).withColumnRenamed("doc_id", "d")
    numbers = windows.where("at = -1").select(F.col("item").alias("i"), "numbers")
    dealt = (
        diagonals.join(groups, F.col("doc_id").eqNullSafe(F.col("d")))
        .join(numbers, F.col("item").eqNullSafe(F.col("i")))
        .groupBy("d", F.pmod(F.xxhash64("item", "shift"), F.col("groups")).alias("group"))
        .agg(F.collect_list(F.struct(F.col("item.item_id").alias("item_id"), "shift", "numbers")).alias("diagonals"))
    )
    name = lambda c: F.pmod(F.xxhash64(c), F.lit(NAMES))
    # at most NAMES numbers are sent, so that texts without hits aren't shuffled
    named = part.join(F.broadcast(diagonals.select(name("doc_id").alias("name")).distinct()), name(F.col("doc_id")) == F.col("name"), "left_semi")
    return (
        named.join(dealt, F.col("doc_id").eqNullSafe(F.col("d")))
        .select("doc_id", "text", "format", "diagonals")
        .mapInArrow(_compare(substitutions, least), f"doc_id {kind}, item_id {item_kind}, {FOUND}")
    )


def leaked_passages(
    documents: DataFrame, doc_id: str, text: str, document_format: str, items: DataFrame, item_id: str, item_text: str, substitutions: int = 1, least: int = LEAST_WORDS, most_sent: int = MOST_SENT
) -> DataFrame:
    """Passages that documents share with evaluation items.

    Result: ``doc_id``, ``item_id``, ``doc_word``, ``item_word`` (where the passage begins, in words),
    ``words`` (its length), ``substituted`` (words in it that differ), ``run`` (the most consecutive equal
    words). A passage has ``least`` equal words at least; between two neighbouring equal words at most
    ``substitutions`` words differ.

    Every window of words is hashed by the seeds of ``seeds_for``, of documents and of items, and the
    hashes are joined; each hit names a diagonal (document, item, offset), on which the words are
    compared. Every passage holds one of the seeds, so none is missed. More than one substitution, or
    a smaller ``least``, leaves seeds of few words, which hit often: right, but slow.

    The items are measured first. Up to ``most_sent`` characters, their windows are sent to the
    documents, which are read once and never shuffled. Larger sets stay distributed: documents give
    the windows that a bitmap of fixed size knows, these are joined with the items' windows by
    shuffle, and documents with hits are read again and compared. Both ways give the same rows.

    Defined results: null texts and items shorter than a window share nothing. Each repeated document
    is reported for itself; equal rows of items count once, other texts of an item's id for themselves.
    Passages of one document and item on several diagonals are several rows.
    """
    seeds = seeds_for(substitutions, least)
    part = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(document_format).alias("format")).where("text is not null")
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > most_sent:
        found = _by_shuffle(part, items, seeds, substitutions, least)
    else:
        kind, item_kind = part.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
        table = items.toArrow().combine_chunks()
        index = EvaluationIndex(table.column("item_id"), table.column("text").to_pylist(), seeds)
        found = part.mapInArrow(_in_place(part.sparkSession.sparkContext.broadcast(index), substitutions, least), f"doc_id {kind}, item_id {item_kind}, {FOUND}")
    return found.withColumnRenamed("doc_id", doc_id) if doc_id != "doc_id" else found
