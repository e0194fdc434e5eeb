"""Lines repeated across the documents of one source, by exact bitmaps of their documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuespark.shared import checkpointed

LEAST_DOCUMENTS = 3
LEAST_SHARE = 5  # a line must be in at least one of this many documents of its source
CONTAINER = 32_768  # bits of one bitmap container
BUCKET = 16_384  # mean number of documents numbered together
MOST_SENT = 1_000_000  # hashes of likely lines that are sent to the records: 8 MB


def letters_only(text: Column) -> Column:
    """Lower case, letters only; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(text), r"[^\p{L}]", ""), F.lit(""))


def number_documents(paths: DataFrame) -> DataFrame:
    """``source``, ``path``, ``container``, ``bit``, ``files``: an exact number for every document of a source.

    Documents are dealt by hash to buckets of about ``BUCKET`` and numbered within them, so the
    numbers are dense and no window holds more than a bucket. A number depends on the set of paths
    only: a task that is run again gives the same ones.
    """
    paths = paths.select("source", "path").distinct()
    sizes = paths.groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    dealt = paths.join(sizes, "source").withColumn("bucket", F.pmod(F.xxhash64("path"), F.ceil(F.col("files") / BUCKET)))
    number = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("path")) - 1
    return dealt.withColumn("number", number).select(
        "source", "path", (F.col("bucket") * (1 << 20) + F.floor(F.col("number") / CONTAINER)).alias("container"), (F.col("number") % CONTAINER).alias("bit"), "files"
    )


def _compact(bitmap: Column) -> Column:
    """A container cut after its last set byte."""
    last = F.length(F.rtrim(F.hex(bitmap), F.lit("0")))
    return F.substring(bitmap, F.lit(1), F.ceil(last / 2).cast("int"))


def holds_bit(bitmap: Column, bit: Column) -> Column:
    """Whether ``bit`` is set in a compacted container."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte, (bit % 8).cast("int")) == 1, F.lit(False))


@dataclass(frozen=True)
class SiteLines:
    """What ``repeated_lines`` gives.

    ``lines``: ``source``, ``key``, ``container``, ``bitmap``, ``documents``, ``files`` of the repeated lines.
    ``candidates``: the records whose line may be one, with ``__source``, ``__key``, ``__container``, ``__bit``.
    ``likely``: the hashes ``__h`` of the candidates' lines; ``hashed``: all records with theirs (null: no line).
    """

    lines: DataFrame
    candidates: DataFrame
    likely: DataFrame
    hashed: DataFrame

    def looked_up(self) -> DataFrame:
        """The candidates with ``__holds``: whether their document's bit is set in their line's bitmap."""
        bitmaps = self.lines.select(F.col("source").alias("__source"), F.col("key").alias("__key"), F.col("container").alias("__container"), F.col("bitmap").alias("__bitmap"))
        placed = self.candidates.join(bitmaps, ["__source", "__key", "__container"], "left")
        return placed.withColumn("__holds", holds_bit(F.col("__bitmap"), F.col("__bit")))


def repeated_lines(records: DataFrame, source: Column, path: str, text: str, least: int = LEAST_DOCUMENTS, share: int = LEAST_SHARE) -> SiteLines:
    """The lines repeated too often in a source, as bitmaps of their documents, and the records to look up in them.

    A line is a text, lower-cased and reduced to its letters; it is repeated if it is in at least
    ``least`` documents and a ``share``-th of all documents of its source.

    One pass counts the rows of every line by hash, an upper bound of its documents, and lists the
    documents of each source; only lines that reach the thresholds by that count can be repeated. A
    second pass takes their records (candidates) with the number of their document. Each variant text
    of a line has its documents as bitmaps of ``CONTAINER`` bits; the variants' bitmaps are united
    into the line's, and its documents counted exactly from the set bits. Shuffled are hashes, paths,
    candidates and bitmaps, not the other texts.

    Defined results: rows with a null path belong to no source. Null texts, and texts without letters,
    are no lines, but their documents count as documents. Repeated rows change nothing. A source with
    fewer than ``least`` documents has no repeated line. The size of a text doesn't matter.
    """
    key = letters_only(F.col(text))
    placed = records.withColumn("__source", F.when(F.col(path).isNotNull(), source)).withColumn("__key", F.when(F.col("__source").isNotNull(), key))
    hashed = placed.withColumn("__h", F.when(F.col("__key").isNotNull(), F.xxhash64("__source", "__key")))
    none = F.lit(None).cast("string")
    both = F.array(F.struct(F.col("__h").alias("h"), none.alias("path")), F.struct(F.lit(None).cast("bigint").alias("h"), F.col(path).alias("path")))
    counted = (
        hashed.where("__source is not null")
        .select(F.col("__source").alias("source"), F.explode(both).alias("x"))
        .where("x.h is not null or x.path is not null")
        .groupBy("source", F.col("x.h").alias("h"), F.col("x.path").alias("path"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= least) | F.col("path").isNotNull())
    )
    counted = checkpointed(counted)  # the documents, and the lines in several rows
    documents = number_documents(counted.where("path is not null"))
    files = counted.where("path is not null").groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    likely = checkpointed(counted.where("h is not null").join(files, "source").where(F.col("n") * share >= F.col("files")).select(F.col("h").alias("__h")).distinct())
    numbered = documents.select(F.col("source").alias("__source"), F.col("path").alias("__path"), F.col("container").alias("__container"), F.col("bit").alias("__bit"), F.col("files").alias("__files"))
    candidates = checkpointed(hashed.join(_sent(likely), "__h", "left_semi").withColumn("__path", F.col(path)).join(numbered, ["__source", "__path"]))
    variants = candidates.groupBy("__source", "__key", F.col(text).alias("__variant"), "__container").agg(F.bitmap_construct_agg("__bit").alias("bits"), F.max("__files").alias("files"))
    united = (
        variants.groupBy(F.col("__source").alias("source"), F.col("__key").alias("key"), F.col("__container").alias("container"))
        .agg(F.bitmap_or_agg("bits").alias("bits"), F.max("files").alias("files"))
        .select("source", "key", "container", _compact(F.col("bits")).alias("bitmap"), F.bitmap_count("bits").alias("held"), "files")
    )
    counts = (
        united.groupBy("source", "key")
        .agg(F.sum("held").alias("documents"), F.max("files").alias("files"))
        .where((F.col("documents") >= least) & (F.col("documents") * share >= F.col("files")))
    )
    lines = united.drop("held", "files").join(counts, ["source", "key"])
    return SiteLines(lines, candidates, likely, hashed)


def _sent(likely: DataFrame) -> DataFrame:
    """``likely``, to be sent to all tasks where it has at most ``MOST_SENT`` rows of one number."""
    return F.broadcast(likely) if likely.count() <= MOST_SENT else likely


def mark_repeated(records: DataFrame, source: Column, path: str, text: str, least: int = LEAST_DOCUMENTS, share: int = LEAST_SHARE) -> DataFrame:
    """The records that hold a repeated line: their document's bit is set in the line's bitmap."""
    return repeated_lines(records, source, path, text, least, share).looked_up().where("__holds").select(*[F.col(f"`{c}`") for c in records.columns])


def remove_repeated(records: DataFrame, source: Column, path: str, text: str, least: int = LEAST_DOCUMENTS, share: int = LEAST_SHARE) -> DataFrame:
    """The records without those that hold a repeated line: the ones that are no candidates, and the candidates whose bit isn't set."""
    found = repeated_lines(records, source, path, text, least, share)
    columns = [F.col(f"`{c}`") for c in records.columns]
    others = found.hashed.join(_sent(found.likely), "__h", "left_anti").select(*columns)
    return others.unionAll(found.looked_up().where("not __holds").select(*columns))
