"""Texts that were decoded with another encoding than they were written in: found and repaired.

A chain is what may have happened to a text: written in one encoding, read in another, once or twice.
Undoing a chain on a word gives another word; how much better that one fits the letter pairs and triples
of the corpus is the evidence for the chain. Which chains happened in a source and field is not known: the
expectation-maximization over all their records estimates it, so that weak evidence (one odd letter)
counts where the chain is common, and not where it isn't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.shared import checkpointed

# (written in, read in, times)
CHAINS: list[tuple[str, str, int]] = [
    ("utf-8", "cp1252", 1), ("utf-8", "cp1252", 2), ("utf-8", "cp1251", 1), ("utf-8", "cp1250", 1), ("utf-8", "iso8859-2", 1),
    ("utf-8", "mac_roman", 1), ("utf-8", "cp850", 1), ("utf-8", "cp437", 1), ("utf-8", "cp866", 1), ("utf-8", "koi8-r", 1),
    ("cp1251", "cp1252", 1), ("cp1251", "koi8-r", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1),
    ("cp1250", "cp1252", 1), ("iso8859-2", "cp1252", 1), ("iso8859-2", "cp1250", 1), ("cp1250", "iso8859-2", 1),
    ("euc_jp", "cp1252", 1), ("shift_jis", "cp1252", 1), ("utf-8", "shift_jis", 1), ("utf-16-le", "utf-16-be", 1), ("cp1252", "mac_roman", 1), ("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1),
    ("utf-8", "cp1251", 2), ("utf-8", "cp1250", 2), ("utf-8", "gbk", 1), ("gbk", "cp1252", 1), ("big5", "cp1252", 1), ("euc_kr", "cp1252", 1),
    ("cp1253", "cp1252", 1), ("cp1254", "cp1252", 1), ("cp1256", "cp1252", 1), ("cp1257", "cp1252", 1),
]
LOST = len(CHAINS)  # the chain that leaves replacement characters; nothing undoes it
BITS = 22
BUCKETS = 1 << BITS  # letter pairs and triples are counted by hash: the model has this size whatever the corpus
TOP = 60  # evidence counts up to this many nats
PAIRS = 0.2  # what the letter pairs weigh against the triples
PRIOR = 0.002  # of each chain, before anything is seen
WEIGHT = 20.0  # records that the prior of a source and field weighs
ROUNDS = 60
LANGUAGE_ALPHA = 0.3
FREE = 0.95  # that share of the buckets is taken for empty: what they hold comes from collisions and rare groups
WORDS_KEPT = 100_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _reader(encoding: str) -> dict[int, int]:
    """Code point to byte of a single-byte encoding; bytes that it leaves open stand for themselves."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
    if encoding.startswith(("cp125", "iso")):
        for b in range(128, 256):
            table.setdefault(b, b)
    return table


WIDE = ("shift_jis", "utf-16-be", "gbk")  # readers of more than one byte a character
_TABLES = {read: _reader(read) for _, read, _ in CHAINS if read not in WIDE}


def _bytes(word: str, read: str) -> bytes | None:
    if read in WIDE:
        try:
            return word.encode(read)
        except UnicodeEncodeError:
            return None
    table = _TABLES[read]
    try:
        return bytes([table[ord(c)] for c in word])
    except KeyError:
        return None


def _decode_utf8(raw: bytes, word: str, narrow: bool) -> str | None:
    """The decoded bytes of a word; null if they aren't UTF-8.

    Bytes that read as white space (85, A0) have ended words, so that sequences are cut in two. A
    last byte A0 is put back to a two-byte letter, or to a longer one in a word with whole letters;
    what is left of other cut sequences stays as it is, if there is a whole letter beside it.
    """
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        if not narrow:
            return None
    begin = 0
    while begin < min(2, len(raw)) and 0x80 <= raw[begin] < 0xC0:
        begin += 1
    end = len(raw)
    for back in range(1, min(3, len(raw) - begin) + 1):
        lead = raw[-back]
        if lead >= 0xC0:
            if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                end = len(raw) - back
            break
    try:
        middle = raw[begin:end].decode("utf-8")
    except UnicodeDecodeError:
        return None
    tail = word[end:]
    if end < len(raw) and len(word) > 2 and (not middle.isascii() or (end == len(raw) - 1 and raw[end] < 0xE0)):
        try:
            return word[:begin] + middle + (raw[end:] + b"\xa0").decode("utf-8")
        except UnicodeDecodeError:
            pass
    return None if middle.isascii() else word[:begin] + middle + tail


def undo(word: str, chain: tuple[str, str, int], first: bytes | None = None) -> str | None:
    """``word`` as it was before ``chain``; null if the chain can't have made it or changes nothing. ``first``: its bytes, if known."""
    written, read, times = chain
    out = word
    for turn in range(times):
        raw = first if turn == 0 and first is not None else _bytes(out, read)
        if raw is None:
            return None
        if written == "utf-8":
            back = _decode_utf8(raw, out, read not in WIDE)
        else:
            try:
                back = raw.decode(written)
            except UnicodeDecodeError:
                back = None
        if back is None or back == out:
            return None
        out = back
    return out


class Letters:
    """Maps text to hashes of neighbouring letters: letters in lower case, except capitals after small letters."""

    def __init__(self):
        points = range(0x3000)
        self.low = np.arange(0x3000, dtype=np.uint32)
        self.small = np.zeros(0x3000, bool)
        for c in points:
            low = chr(c).lower()
            self.low[c] = ord(low) if len(low) == 1 else c
            self.small[c] = chr(c).islower()

    def grams(self, spaced: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of each two and of each three neighbours; and which of both have a letter beyond ASCII."""
        points = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32)
        table = points < 0x3000
        safe = np.where(table, points, 0)
        low = np.where(table, self.low[safe], points)
        after_small = np.concatenate(([False], (self.small[safe] & table)[:-1]))
        low = np.where(after_small, points, low).astype(np.uint64)
        far = low > 127
        a, b, c = low[:-2], low[1:-1], low[2:]
        with np.errstate(over="ignore"):
            two = (low[:-1] * _MIX[0]) ^ (low[1:] * _MIX[1])
            three = (a * _MIX[1]) ^ (b * _MIX[2]) ^ (c * _MIX[3]) ^ _MIX[0]
            out = [(x ^ (x >> np.uint64(31))) * _MIX[2] for x in (two, three)]
        two, three = ((x >> np.uint64(64 - BITS)).astype(np.int64) for x in out)
        return two, three, far[:-1] | far[1:], far[:-2] | far[1:-1] | far[2:]


_LETTERS: list[Letters] = []


def _letters() -> Letters:
    if not _LETTERS:
        _LETTERS.append(Letters())
    return _LETTERS[0]


def model_of(counts: np.ndarray) -> np.ndarray:
    """Log shares of the letter groups from the counts of their buckets.

    What nearly every bucket holds says nothing about its letters: the count that ``FREE`` of all
    buckets keep within is taken off. So the groups that a corpus knows are those that stand out,
    whether few buckets are used or, in a large corpus, all of them.
    """
    counts = np.maximum(counts - np.partition(counts, int(FREE * (len(counts) - 1)))[int(FREE * (len(counts) - 1))], 0)
    return np.log((counts + LANGUAGE_ALPHA) / (counts.sum() + LANGUAGE_ALPHA * len(counts))).astype(np.float32)


def letter_counts(texts: DataFrame) -> DataFrame:
    """``bucket``, ``source``, ``field``, ``n``: the letter pairs and triples of all texts by bucket, and in bucket -1 the texts of each source and field."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, counts, waiting, records = _letters(), np.zeros(BUCKETS, np.int64), [], {}
        for batch in batches:
            found = [x for x in batch.column("text").to_pylist() if x]
            if found:
                waiting += letters.grams(f" {' '.join(found)} ")[:2]
            if sum(map(len, waiting)) > BUCKETS:
                counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                waiting = []
            groups = pa.Table.from_batches([batch]).group_by(["source", "field"]).aggregate([([], "count_all")]).to_pylist()
            for g in groups:
                key = (g["source"], g["field"])
                records[key] = records.get(key, 0) + g["count_all"]
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        names = ["bucket", "source", "field", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string()), pa.array(counts[at], pa.int64())], names)
        seen = [pa.array([k[i] for k in records], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(records), pa.int32()), *seen, pa.array(list(records.values()), pa.int64())], names)

    counted = texts.select("source", "field", "text").mapInArrow(kernel, "bucket int, source string, field string, n bigint")
    return checkpointed(counted.groupBy("bucket", "source", "field").agg(F.sum("n").alias("n")))


def letter_model(counted: DataFrame) -> np.ndarray:
    """The model of ``letter_counts``: an array of ``BUCKETS`` numbers, and only that, on the driver."""
    counts = np.zeros(BUCKETS, np.int64)
    summed = counted.where("bucket >= 0").select("bucket", "n").toArrow()  # at most BUCKETS rows
    counts[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return model_of(counts)


class Evidence:
    """What words say for each chain, against a model of letters."""

    def __init__(self, model: np.ndarray):
        self.model, self.unseen, self.words = model, float(model.min()) + 1e-3, {}

    def fits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of the letters of each text, triples before pairs, and the share of its groups that the corpus knows.

        The share is that of groups with a letter beyond ASCII, if there are any.
        """
        sizes = np.array([len(t) + 2 for t in texts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        two, three, far_two, far_three = _letters().grams("".join(f" {t} " for t in texts))
        own_two, own_three = np.ones(ends[-1], bool), np.ones(ends[-1], bool)  # groups within one text
        own_two[ends - 1] = own_three[ends - 1] = own_three[ends - 2] = False
        pairs, triples = np.append(self.model[two], np.float32(0)), np.append(self.model[three], np.zeros(2, np.float32))
        far_two, far_three = np.append(far_two, False) & own_two, np.append(far_three, [False, False]) & own_three
        total = lambda x: np.add.reduceat(x.astype(np.float64), starts)
        fit = PAIRS * total(np.where(own_two, pairs, 0)) + (1 - PAIRS) * total(np.where(own_three, triples, 0))
        known_two, known_three = pairs > self.unseen, triples > self.unseen
        far = total(far_two) + total(far_three)
        known_far = total(far_two & known_two) + total(far_three & known_three)
        known_all = total(own_two & known_two) + total(own_three & known_three)
        return fit, np.where(far > 0, known_far / np.maximum(far, 1), known_all / (2 * sizes - 3))

    def of_word(self, word: str) -> list[tuple[int, float, str]]:
        """(chain, nats, repaired) for the chains that ``word`` speaks for."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            known, raws, backs = [], {}, []
            for k, chain in enumerate(CHAINS):
                read = chain[1]
                if read not in raws:
                    raws[read] = _bytes(word, read)
                back = None if raws[read] is None else undo(word, chain, raws[read])
                if back:
                    backs.append((k, back))
            if backs:
                fit, share = self.fits([word, *(b for _, b in backs)])
                # a word made of groups that the corpus doesn't know says nothing
                known = [(k, float(fit[i] - fit[0]), back) for i, (k, back) in enumerate(backs, 1) if share[i] > 0.5 and fit[i] > fit[0]]
            if len(word) <= 200:
                self.words[word] = known
        return known

    def of_text(self, text: str) -> list[tuple[int, int]]:
        """Every (chain, whole nats up to ``TOP``) that a text speaks for, by chain; only those ``TOP`` and more behind the first are left out."""
        total: dict[int, float] = {LOST: TOP} if "�" in text else {}
        for word in text.split(" "):
            if not word.isascii() and "�" not in word:
                for k, gain, _ in self.of_word(word):
                    total[k] = total.get(k, 0.0) + gain
        # what is over the top is taken from all, so that their differences stay
        over = max(0.0, max(total.values(), default=0.0) - TOP)
        return sorted((k, n) for k, n in ((k, int(round(g - over))) for k, g in total.items()) if n >= 1)

    def repair(self, text: str, chain: int, shares: list[float]) -> tuple[str | None, list[int]]:
        """``text`` with its garbled words undone, and the chains that were; null where there is nothing to undo.

        Words that speak for ``chain``, the text's, are undone by it. Another chain undoes a word for which it
        stands further ahead than its share in the source and ``PRIOR`` speak against a second chain in one
        text. Words with lost characters stay.
        """
        against = [0.0 if k == chain else math.log(max(p, 1e-300)) + math.log(PRIOR) for k, p in enumerate(shares)]
        out, used = [], [LOST] if "�" in text else []
        for word in text.split(" "):
            best = None
            if not word.isascii() and "�" not in word:
                said = [(gain + against[k], -k, back) for k, gain, back in self.of_word(word)]
                best = max(said, default=None)
            if best is None or best[0] <= 0:
                out.append(word)
                continue
            out.append(best[2])
            if -best[1] not in used:
                used.append(-best[1])
        back = " ".join(out)
        return (None if back == text else back), used or [chain]


def gather_evidence(texts: DataFrame, keep: list[str], text: str, model: np.ndarray) -> DataFrame:
    """``keep``, ``text`` and ``evidence`` (array of chain and nats) of the texts with a letter beyond ASCII that speak for a chain."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    rows = texts.select(*keep, F.col(text).alias("text")).where(F.col("text").rlike(r"[^\x00-\x7F]"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value)
        kind = pa.list_(pa.struct([("chain", pa.int32()), ("nats", pa.int32())]))
        for batch in batches:
            found = [evidence.of_text(x) for x in batch.column("text").to_pylist()]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            said = pa.array([[{"chain": k, "nats": n} for k, n in f] for f in found if f], kind)
            taken = batch.take(at)
            yield pa.RecordBatch.from_arrays([*taken.columns, said], [*batch.schema.names, "evidence"])

    return rows.mapInArrow(kernel, f"{kinds}, evidence array<struct<chain:int,nats:int>>")


def maximize(signatures: list[list[tuple[int, int]]], counts: np.ndarray, silent: float, prior: np.ndarray) -> np.ndarray:
    """The shares of the chains (last: none) by expectation-maximization with a Dirichlet prior of ``WEIGHT`` records.

    ``signatures`` are distinct evidences with their ``counts``; ``silent`` records speak for nothing.
    """
    width = len(prior)
    gain = np.full((len(signatures), width), -np.inf)
    gain[:, -1] = 0.0
    for i, s in enumerate(signatures):
        for k, n in s:
            gain[i, k] = n
    share = prior.copy()
    with np.errstate(divide="ignore"):
        for _ in range(ROUNDS):
            score = gain + np.log(share)
            score -= score.max(axis=1, keepdims=True)
            belief = np.exp(score)
            belief /= belief.sum(axis=1, keepdims=True)
            got = (belief * counts[:, None]).sum(axis=0) + WEIGHT * prior
            got[-1] += silent
            new = got / got.sum()
            if np.abs(new - share).max() < 1e-9:
                share = new
                break
            share = new
    return share


def _decide(signature: list[tuple[int, int]], share: np.ndarray) -> tuple[int, float]:
    """The likeliest chain of a signature and the posterior of any chain at all."""
    score = {k: n + math.log(max(share[k], 1e-300)) for k, n in signature}
    none = math.log(max(share[-1], 1e-300))
    top = max([*score.values(), none])
    weight = {k: math.exp(v - top) for k, v in score.items()}
    any_ = sum(weight.values())
    return max(weight, key=lambda k: (weight[k], -k)), any_ / (any_ + math.exp(none - top))


def _base() -> np.ndarray:
    prior = np.full(LOST + 2, PRIOR)
    prior[-1] = 1.0 - PRIOR * (LOST + 1)
    return prior


def _signatures(frame: pd.DataFrame) -> tuple[list[list[tuple[int, int]]], np.ndarray, float]:
    """Distinct evidences, their counts, and the number of silent records of a group."""
    spoken = frame[frame["evidence"].map(lambda e: e is not None and len(e) > 0)]
    silent = float(frame["n"].sum() - spoken["n"].sum())
    return [[(int(x["chain"]), int(x["nats"])) for x in e] for e in spoken["evidence"]], spoken["n"].to_numpy(float), silent


def posteriors(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """``source``, ``field``, ``evidence``, ``chain``, ``posterior``, ``shares`` (of the chains) of each distinct evidence of a source and field.

    ``evidence`` has ``source``, ``field`` and ``evidence``, ``records`` the number ``n`` of all records of
    each source and field. What is aggregated and estimated are the distinct evidences with their
    counts: at most as many as there are pairs of chains and of nats up to ``TOP``, whatever the
    number of records. A field's shares over all sources are the prior of its shares in a source.
    """
    distinct = evidence.groupBy("source", "field", "evidence").agg(F.count(F.lit(1)).alias("n"))
    spoke = distinct.groupBy("source", "field").agg(F.sum("n").alias("spoke"))
    silent = records.join(spoke, ["source", "field"], "left").select(
        "source", "field", F.lit(None).cast("array<struct<chain:int,nats:int>>").alias("evidence"), (F.col("n") - F.coalesce("spoke", F.lit(0))).alias("n")
    )
    table = distinct.unionByName(silent)

    def over_all(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"field": [frame["field"].iloc[0]], "prior": [maximize(*_signatures(frame), _base()).tolist()]})

    priors = table.groupBy("field", "evidence").agg(F.sum("n").alias("n")).groupBy("field").applyInPandas(over_all, "field string, prior array<double>")

    def in_source(frame: pd.DataFrame) -> pd.DataFrame:
        signatures, counts, silent = _signatures(frame)
        share = maximize(signatures, counts, silent, np.array(frame["prior"].iloc[0], float))
        decided = [_decide(s, share) for s in signatures]
        return pd.DataFrame(
            {
                "source": frame["source"].iloc[0],
                "field": frame["field"].iloc[0],
                "evidence": [[{"chain": k, "nats": n} for k, n in s] for s in signatures],
                "chain": [d[0] for d in decided],
                "posterior": [d[1] for d in decided],
                "shares": [share.tolist()] * len(decided),
            }
        )

    # one prior per field, a handful of rows: fields are named by the caller
    return (
        table.join(F.broadcast(priors), "field")
        .groupBy("source", "field")
        .applyInPandas(in_source, "source string, field string, evidence array<struct<chain:int,nats:int>>, chain int, posterior double, shares array<double>")
    )


CHAIN_NAMES = [f"{w} read as {r}" + " twice" * (t == 2) for w, r, t in CHAINS] + ["lost characters"]


def _decided(table: DataFrame, record_id: str, source: Column, fields: list[str], least: float) -> tuple[DataFrame, np.ndarray]:
    """The garbled records, and the model of letters that they were judged by."""
    kind = dict(table.dtypes)[record_id]
    long = table.select(
        F.col(record_id).cast(kind).alias("record"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"),
    ).select("record", "source", "x.field", "x.text")
    long = long.where(F.col("text").isNotNull())
    counted = letter_counts(long)
    model = letter_model(counted)
    # read for the shares and for the decisions, but gathered once: the few texts that speak for a chain
    evidence = checkpointed(gather_evidence(long, ["record", "source", "field"], "text", model))
    records = counted.where("bucket = -1").select("source", "field", "n")
    decided = posteriors(evidence.select("source", "field", "evidence"), records).where(F.col("posterior") > least)
    found = evidence.join(decided, ["source", "field", "evidence"])
    return found.select(F.col("record").alias(record_id), "field", "source", "text", "chain", "posterior", "shares"), model


def find_garbled(table: DataFrame, record_id: str, source: Column, fields: list[str], least: float = 0.5) -> DataFrame:
    """``record_id``, ``field``, ``source``, ``text``, ``chain`` (number), ``posterior`` of the garbled records.

    A record is garbled in a field if the posterior of any chain is over ``least``, given its evidence
    and the shares of the chains in its source and field; a text with replacement characters is.

    The letter pairs and triples are counted over all texts of all fields. Two passes read the texts:
    for the letters (with the number of texts) and for the evidence. Both results are written to the
    shared folder: counts by bucket, and the texts that speak for a chain.

    Defined results: null texts and texts in ASCII are not garbled. A null source is a source of its
    own. Repeated records are decided alike, each for itself. Any length of text is fine.
    """
    return _decided(table, record_id, source, fields, least)[0].drop("shares")


def repair_garbled(table: DataFrame, record_id: str, source: Column, fields: list[str], least: float = 0.5) -> DataFrame:
    """The garbled records with the ``chain``'s name and the text as it was (``repaired``; null if nothing can be undone).

    A text that several chains garbled is undone word by word, and has all their names, the one that
    decided first. Beside lost characters, which stay, the other words of a text are restored.
    """
    found, letters = _decided(table, record_id, source, fields, least)
    model = table.sparkSession.sparkContext.broadcast(letters)  # BUCKETS numbers

    @F.pandas_udf("repaired string, chain string")
    def undone(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        evidence = Evidence(model.value)
        for texts, chains, shares in batches:
            made = [evidence.repair(t, int(k), s) for t, k, s in zip(texts, chains, shares)]
            names = [" + ".join(CHAIN_NAMES[k] for k in sorted(used, key=lambda k: k != c)) for (_, used), c in zip(made, chains)]
            yield pd.DataFrame({"repaired": pd.Series([m[0] for m in made], dtype=object), "chain": pd.Series(names, dtype=object)})

    return found.select(record_id, "field", "source", "text", "posterior", undone("text", "chain", "shares").alias("u")).select(
        record_id, "field", "source", "text", F.col("u.chain").alias("chain"), "posterior", F.col("u.repaired").alias("repaired")
    )
