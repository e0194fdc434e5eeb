"""Mixing of sources to target shares of the total size in tokens, by systematic sampling."""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.shared import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 4_000  # characters; longer texts are counted in pieces that end before a blank
UNIT = 1 << 32  # one copy, in the integers that expected copies are counted in
SLOTS = 4_096  # stretches that the order of a source's documents is cut into
LEVELS = 64  # stretches of one part
ORDER_BITS = 60

_ENCODERS: dict[str, object] = {}


def _encoder(vocabulary: str):
    if vocabulary not in _ENCODERS:
        tiktoken = importlib.import_module("tiktoken")
        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about ``PIECE`` characters, cut only between a letter or digit and one blank before a letter.

    The pattern always ends a match there, so the pieces have together the tokens of the whole.
    """
    begin = 0
    while len(text) - begin > 2 * PIECE:
        at = begin + PIECE
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = len(text)
                break
            if text[at - 1].isalpha() and text[at + 1].isalpha():
                break
            at += 1
        if at >= len(text):
            break
        yield text[begin:at]
        begin = at
    yield text[begin:]


def count_tokens(documents: DataFrame, text: str, tokens: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` with the number of tokens of ``text`` in place of it, as ``tokens``; null has none (0).

    ``vocabulary`` is the path of a public byte-level BPE rank file, present on every executor. Equal
    texts of a batch are counted once.
    """
    schema = documents.drop(text).withColumn(tokens, F.lit(0).cast("bigint")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        for batch in batches:
            at = batch.schema.get_field_index(text)
            coded = batch.column(at).dictionary_encode()
            sizes = [sum(len(encode(p)) for p in _pieces(x)) for x in coded.dictionary.to_pylist()]
            counts = pa.array([0 if c is None else sizes[c] for c in coded.indices.to_pylist()], pa.int64())
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), counts], [*names, tokens])

    return documents.select(*documents.drop(text).columns, text).mapInArrow(kernel, schema)


def source_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of ``targets`` (``source``, ``target_share``, ``max_repeats``) can give.

    ``sized`` has ``source`` and ``tokens``. Result, one row per listed source: ``size`` (tokens of its
    documents), ``total`` (of all listed sources, each used once), ``wanted`` = target_share * total,
    ``most`` = size * max_repeats, ``short`` (most < wanted), ``used`` (the lesser of the two) and
    ``rate``, the expected copies of each document.

    Sources that aren't listed are left out; a listed source without documents has size 0 and is
    short if anything is wanted of it.
    """
    listed = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull())
    sizes = sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("size"))
    plan = listed.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))
    total = plan.agg(F.sum("size").alias("total"))
    plan = plan.join(F.broadcast(total))  # one row
    wanted, most = F.col("target_share") * F.col("total"), F.col("size") * F.col("max_repeats")
    used = F.least(wanted, most.cast("double"))
    return plan.withColumns(
        {"wanted": wanted, "most": most, "short": F.coalesce(most < wanted, F.lit(False)), "used": used, "rate": F.when(F.col("size") > 0, used / F.col("size")).otherwise(0.0)}
    )


def draw_order(key: Column, seed: int) -> Column:
    """A random order of 60 bits that any engine can compute: the first 15 digits of the MD5 of key and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("bigint")


def systematic_copies(rows: DataFrame, group: str, order: Column, expected: Column, seed: int, copies: str) -> DataFrame:
    """``rows`` with how often each is emitted, as ``copies``: systematic sampling within ``group``.

    ``expected`` (copies, at least 0) is summed up along ``order`` (an integer of 60 bits, as of
    ``draw_order``); one random offset per group is added, and a row is emitted once for each integer
    its stretch crosses. So a row has its expected copies rounded up or down, and a group its sum.

    The sums are integers of 38 digits (``UNIT`` a copy): they don't depend on the order in which they
    are added, and hold 10^28 copies. A group is cut into ``SLOTS`` stretches by the order; sums run
    within a stretch, over the stretches of a part of the group, and over the parts.
    """
    # the slot is the upper twelve bits of the order; along the group, slots come first and then the order
    slot = F.shiftright(order, ORDER_BITS - 12)
    rows = rows.withColumns({"__order": order, "__units": F.round(expected * UNIT).cast("decimal(28,0)")})
    rows = rows.withColumns({"__slot": slot, "__part": F.floor(slot / LEVELS)})
    names = [c for c in rows.columns if not c.startswith("__")]
    before = lambda *keys: Window.partitionBy(*keys)
    zero = F.lit(0).cast("decimal(38,0)")
    within = before(group, "__slot").orderBy("__order", *names).rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy(group, "__part", "__slot").agg(F.sum("__units").alias("__sum"))
    parts = slots.groupBy(group, "__part").agg(F.sum("__sum").alias("__psum"))
    along = lambda c, o, *keys: F.coalesce(F.sum(c).over(before(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), zero)
    parts = parts.select(group, "__part", along("__psum", "__part", group).alias("__pbefore"))
    slots = slots.withColumn("__sbefore", along("__sum", "__slot", group, "__part")).join(parts, [group, "__part"]).select(
        group, "__slot", (F.col("__sbefore") + F.col("__pbefore")).alias("__before")
    )
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(group), F.lit(str(seed)))), 1, 8), 16, 10).cast("decimal(28,0)")
    whole = lambda x: F.call_function("div", x, F.lit(UNIT).cast("decimal(28,0)"))
    return (
        rows.withColumn("__own", F.coalesce(F.sum("__units").over(within), zero))
        .join(slots, [group, "__slot"])
        .withColumn("__begin", F.col("__before") + F.col("__own") + offset)
        .withColumn(copies, whole(F.col("__begin") + F.col("__units")) - whole(F.col("__begin")))
        .select(*names, copies)
    )


def mix_sized(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """The mix of documents of known sizes (``doc_id``, ``source``, ``tokens``): those used at least once, with ``copies``."""
    plan = source_plan(sized, targets).select("source", "rate")
    rated = sized.join(plan, "source").where(F.col("rate") > 0)
    drawn = systematic_copies(rated, "source", draw_order(F.col("doc_id"), seed), F.col("rate"), seed, "copies")
    return drawn.where(F.col("copies") > 0).select("doc_id", "source", "tokens", "copies")


def report_sized(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Per listed source: target and actual share of the mix, tokens and documents in it, most copies, short."""
    got = mix_sized(sized, targets, seed).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    whole = got.agg(F.sum("mixed_tokens").alias("whole"))
    zero = F.lit(0).cast("bigint")
    return (
        source_plan(sized, targets).join(got, "source", "left")
        .join(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "size", "max_repeats", "short",
            F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), F.coalesce("documents", zero).alias("documents"),
            F.coalesce("most_copies", zero).alias("most_copies"), F.coalesce(F.col("mixed_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
        )
    )


def _sized(documents: DataFrame, doc_id: str, text: str, vocabulary: str) -> DataFrame:
    sized = count_tokens(documents.select(F.col(doc_id).alias("doc_id"), "source", F.col(text).alias("text")), "text", "tokens", vocabulary)
    return checkpointed(sized)  # read twice, but its tokens are counted once


def mix(documents: DataFrame, doc_id: str, text: str, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mix: ``doc_id``, ``source``, ``tokens``, ``copies`` of the documents that are used at least once.

    Each listed source gives ``used`` tokens of its plan in expectation, no document more than
    ``max_repeats`` copies. Repeated ids are rows of their own. See ``source_plan`` for the rest.
    """
    return mix_sized(_sized(documents, doc_id, text, vocabulary), targets, seed)


def mix_report(documents: DataFrame, doc_id: str, text: str, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY) -> DataFrame:
    """What ``mix`` gives per listed source: see ``report_sized``."""
    return report_sized(_sized(documents, doc_id, text, vocabulary), targets, seed)
