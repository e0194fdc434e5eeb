"""One form for texts that look alike: skeletons of strings, and phrases found by look."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like, by the form (small or
# capital) in which they do.
SMALL = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "υ": "u", "χ": "x", "γ": "y", "τ": "t", "ϲ": "c", "ϳ": "j",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꙅ": "s",
}
CAPITAL = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ѕ": "S", "Ј": "J", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Օ": "O", "Տ": "S", "Ս": "U", "Ԍ": "G", "Ꙅ": "S",
}
# Letters of further scripts, by their Unicode names, and the Latin letters they look like.
SMALL_NAMED = {
    "ARMENIAN SMALL LETTER": "CO=g ZA=q YI=j RA=n",
    "CHEROKEE LETTER": "V=i NI=h SI=b TSU=d",
    "COPTIC SMALL LETTER": "ALFA=a EIE=e O=o RO=p SIMA=c KHI=x",
    "DESERET SMALL LETTER": "LONG_O=o CHEE=c ZHEE=s",
    "GEORGIAN LETTER": "LABIAL_SIGN=o",
    "OSAGE SMALL LETTER": "O=o",
}
CAPITAL_NAMED = {
    "CHEROKEE LETTER": "GO=A YV=B TLI=C A=D GV=E NAH=G MI=H GU=J TSO=K TLE=L LU=M TLV=P E=R DU=S I=T DO=V LA=W TA=W MU=Y NO=Z",
    "COPTIC CAPITAL LETTER": "ALFA=A VIDA=B EIE=E ZATA=Z HATE=H IAUDA=I KAPA=K MI=M NI=N O=O RO=P SIMA=C TAU=T UA=Y KHI=X",
    "DESERET CAPITAL LETTER": "LONG_O=O CHEE=C ZHEE=S",
    "LISU LETTER": "BA=B PA=P DA=D TA=T GA=G KA=K JA=J CA=C DZA=Z TSA=F MA=M NA=N LA=L SA=S ZHA=R HA=V XA=H WA=W SHA=X YA=Y A=A E=E I=I O=O U=U",
    "OLD ITALIC LETTER": "A=A BE=B KE=C E=E VE=F I=I TE=T EKS=X",
    "OSAGE CAPITAL LETTER": "O=O",
    "LATIN LETTER SMALL CAPITAL": "B=B G=G H=H I=I L=L N=N R=R A=A D=D E=E J=J K=K M=M P=P T=T U=U",
}


def _named(scripts: dict[str, str]) -> dict[str, str]:
    pairs = ((script, pair.split("=")) for script, listed in scripts.items() for pair in listed.split())
    return {unicodedata.lookup(f"{script} {name.replace('_', ' ')}"): look for script, (name, look) in pairs}


SMALL |= _named(SMALL_NAMED)
CAPITAL |= _named(CAPITAL_NAMED)
MARKS = {"‐": "-", "‑": "-", "ʼ": "’", "＇": "'"}
# The ranges of code points that are ignored by default.
IGNORABLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]

_DROP = {c: None for a, b in IGNORABLE if b - a < 4096 for c in range(a, b + 1)}
# as written: small letters by their small look, capitals by their capital look
_AS_WRITTEN = _DROP | {ord(k): v for k, v in (SMALL | {k: v.lower() for k, v in CAPITAL.items()} | MARKS).items()}
# as capitals: letters of either case by the look of the capital
_AS_CAPITALS = _DROP | {ord(x): v.lower() for k, v in CAPITAL.items() for x in (k, k.lower())} | {ord(k): v for k, v in MARKS.items()}
_AS_CAPITALS = {ord(k): v for k, v in SMALL.items()} | _AS_CAPITALS

CACHE = 50_000


def _form(text: str, table: dict) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    apart = unicodedata.normalize("NFKD", text).translate(table)
    folded = unicodedata.normalize("NFKD", apart.casefold()).translate(table)
    return unicodedata.normalize("NFC", " ".join(folded.split()))


def canonical_form(text: str) -> str:
    """Compatibility composed form, full case folding, single blanks, without ignorable characters.

    Unlike ``skeletons`` it keeps the letters of all scripts: the form to store and to compare by.
    """
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).translate(_DROP).casefold()).translate(_DROP)
    return " ".join(folded.split())


def skeletons(text: str) -> tuple[str, str]:
    """Two forms, by the look of the text as written and in capitals; texts that share one look alike.

    Letter case makes no difference; another accent or letter does. Two forms are needed as some
    letters look like one Latin letter when small and like another one as capitals.
    """
    return _form(text, _AS_WRITTEN), _form(text, _AS_CAPITALS)


class _Phrases:
    """Finds phrases by look in texts; works on each distinct text once."""

    def __init__(self, phrases: list[tuple[int, str]], whole: bool):
        self.phrases = [(i, p, p.lower(), *skeletons(p)) for i, p in phrases if p and p.strip()]
        self.whole, self.seen = whole, {}
        self.finders = None if whole else [_finder([(f[k], n) for n, f in enumerate(self.phrases)]) for k in (3, 4)]
        self.equal: dict[str, set[int]] = {}
        if whole:
            for n, f in enumerate(self.phrases):
                for k in (3, 4):
                    self.equal.setdefault((k, f[k]), set()).add(n)

    def find(self, text: str) -> list[int]:
        got = self.seen.get(text)
        if got is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            got = self.seen[text] = self._find(text)
        return got

    def _find(self, text: str) -> list[int]:
        forms = skeletons(text)
        if self.whole:
            hits = self.equal.get((3, forms[0]), set()) | self.equal.get((4, forms[1]), set())
        else:
            hits = self.finders[0](forms[0]) | self.finders[1](forms[1])
        if not hits:
            return []
        low = text.lower()
        own = (lambda f: f[2] == low) if self.whole else (lambda f: f[2] in low)
        return sorted(self.phrases[n][0] for n in hits if not own(self.phrases[n]))


def _finder(needles: list[tuple[str, int]]) -> Callable[[str], set[int]]:
    """One pass over a text for all phrases; without the automaton library, a search for each."""
    by: dict[str, set[int]] = {}
    for needle, n in needles:
        by.setdefault(needle, set()).add(n)
    try:
        import ahocorasick
    except ImportError:
        return lambda text: set().union(*(v for k, v in by.items() if k in text))
    automaton = ahocorasick.Automaton()
    for needle, found in by.items():
        automaton.add_word(needle, found)
    if not by:
        return lambda text: set()
    automaton.make_automaton()

    def find(text: str) -> set[int]:
        out: set[int] = set()
        for _, found in automaton.iter(text):
            out |= found
        return out

    return find


MOST_PHRASES = 1_000_000


def phrase_blocks(phrases: DataFrame, index: str, query: str) -> list[list[tuple[int, str]]]:
    """The phrase list in blocks for the driver: one of up to ``MOST_PHRASES``, or as many as a longer list needs.

    Each block is looked for in a pass of its own; together they find what one list of all would.
    """
    listed = phrases.select(F.col(index).alias("i"), F.col(query).alias("q")).where("q is not null")
    blocks = max(1, -(-listed.count() // MOST_PHRASES))
    return [[(r[0], r[1]) for r in listed.where(F.pmod(F.xxhash64("i", "q"), F.lit(blocks)) == b).collect()] for b in range(blocks)]


def find_lookalikes(table: DataFrame, record_id: str, text: str, phrases: list[tuple[int, str]], whole: bool = False) -> DataFrame:
    """``record_id``, ``query_index``: records whose text looks as if it held a phrase, in other characters.

    ``text`` is a string column or an array of strings (then each element counts on its own). With
    ``whole`` an element must look like the whole phrase and, lower-cased, be another string; else it
    must hold something that looks like the phrase and, lower-cased, not hold the phrase itself.

    Defined results: null texts, null arrays and null elements look like nothing; blank phrases are
    left out; a repeated record gives repeated rows only if its id is repeated, and a phrase is
    given once per row. Cost is linear in the text, for any number of phrases.
    """
    kind = dict(table.dtypes)[record_id]
    many = dict(table.dtypes)[text].startswith("array")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Phrases(phrases, whole)
        for batch in batches:
            ids, found = [], []
            rows = batch.column(1)
            # each distinct text of a batch is looked at once
            coded = (rows.flatten() if many else rows).dictionary_encode()
            hits = [finder.find(x) if x is not None else [] for x in coded.dictionary.to_pylist()]
            if any(hits):
                codes = coded.indices.to_pylist()
                parents = pa.compute.list_parent_indices(rows).to_pylist() if many else range(len(codes))
                per: dict[int, set[int]] = {}
                for at, code in zip(parents, codes):
                    if code is not None and hits[code]:
                        per.setdefault(at, set()).update(hits[code])
                for at, queries in per.items():
                    for q in sorted(queries):
                        ids.append(at)
                        found.append(q)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(found, pa.int32())], ["record_id", "query_index"])

    import pyarrow.compute  # noqa: F401

    return table.select(F.col(record_id), F.col(text)).mapInArrow(kernel, f"record_id {kind}, query_index int")


def unify(table: DataFrame, text: str, prefix: str = "unified") -> DataFrame:
    """``table`` with the forms to store and to compare a string column by; null stays null.

    Of an array of strings, the forms are arrays with a place for each element.
    ``<prefix>`` is ``canonical_form``; ``<prefix>_look`` and ``<prefix>_capitals`` are the two ``skeletons``:
    texts that share one of them look alike. Each distinct text of a batch is formed once.
    """

    kinds = ["form", "look", "capitals"]
    many = dict(table.dtypes)[text].startswith("array")

    def formed_of(texts: pd.Series) -> pd.DataFrame:
        codes, distinct = pd.factorize(texts)
        made = [(canonical_form(x), *skeletons(x)) for x in distinct] + [(None, None, None)]
        out = pd.DataFrame(made, columns=kinds, dtype=object)
        return out.take(codes).reset_index(drop=True)

    @F.pandas_udf(", ".join(f"{n} {'array<string>' if many else 'string'}" for n in kinds))
    def forms(texts: pd.Series) -> pd.DataFrame:
        if not many:
            return formed_of(texts)
        flat = formed_of(pd.Series([x for t in texts if t is not None for x in t], dtype=object))
        ends = [0, *itertools.accumulate(0 if t is None else len(t) for t in texts)]
        return pd.DataFrame({n: pd.Series([None if t is None else list(flat[n][a:b]) for t, a, b in zip(texts, ends, ends[1:])], dtype=object) for n in kinds})

    formed = table.withColumn("__forms", forms(F.col(text)))
    names = {prefix: "form", f"{prefix}_look": "look", f"{prefix}_capitals": "capitals"}
    return formed.select(*table.columns, *[F.col(f"__forms.{v}").alias(k) for k, v in names.items()])
