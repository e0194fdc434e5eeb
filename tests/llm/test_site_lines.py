import random

from pyspark.sql import functions as F

from cuespark.llm import site_lines
from cuespark.llm.site_lines import holds_bit, mark_repeated, number_documents, remove_repeated, repeated_lines

SCHEMA = "match_id bigint, path string, text string, source string, key string, bit int, container int, files int"


def table(spark, rows):
    return spark.createDataFrame([(i, p, t, "x", "y", 1, 2, 3) for i, p, t in rows], SCHEMA)


def site():
    return F.split_part(F.col("path"), F.lit("/"), F.lit(1))


def brute(rows):
    letters = lambda t: "".join(c for c in t.lower() if c.isalpha()) if t is not None else ""
    files, lines = {}, {}
    for _, p, t in rows:
        if p is not None:
            files.setdefault(p.split("/")[0], set()).add(p)
            if letters(t):
                lines.setdefault((p.split("/")[0], letters(t)), set()).add(p)
    bad = {k for k, v in lines.items() if len(v) >= 3 and len(v) * 5 >= len(files[k[0]])}
    return sorted(i for i, p, t in rows if p is not None and (p.split("/")[0], letters(t)) in bad)


def corpus():
    rng = random.Random(4)
    rows = []
    for s, files in (("big", 60), ("mid", 14), ("two", 2), ("three", 3)):
        for f in range(files):
            for k in range(12):
                text = rng.choice(["*** Share this! ***", "share THIS 12", "Legal notice", f"line {s} {f} {'abcdefghijkl'[k]}", None, "123", "", "rare one"] if k < 3 else [f"own {s} {'abcdefghijkl'[f % 12]} {'abcdefghijkl'[k]} {rng.random()}"])
                rows.append((len(rows), f"{s}/{f}.srt", text))
    return rows + [(len(rows), None, "Legal notice"), (10**9, "big/0.srt", "Share this")]


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    for bucket, container, sent in ((16_384, 32_768, 1_000_000), (4, 8, 0)):
        monkeypatch.setattr(site_lines, "BUCKET", bucket)
        monkeypatch.setattr(site_lines, "MOST_SENT", sent)
        monkeypatch.setattr(site_lines, "CONTAINER", container)
        got = sorted(r.match_id for r in mark_repeated(table(spark, rows), site(), "path", "text").collect())
        assert got == brute(rows) and got
        left = sorted(r.match_id for r in remove_repeated(table(spark, rows), site(), "path", "text").collect())
        assert left == sorted({r[0] for r in rows} - set(got))


def test_counts_are_exact(spark):
    found = repeated_lines(table(spark, [(i, f"s/{i % 7}", "A b!" if i % 2 else "ab") for i in range(70)]), site(), "path", "text")
    assert [(r.source, r.key, r.documents, r.files, bytes(r.bitmap)) for r in found.lines.collect()] == [("s", "ab", 7, 7, b"\x7f")]


def test_a_document_whose_bit_is_not_set_keeps_its_line(spark):
    """The lookup decides: with another document's bitmap in place of the line's own, its records stay."""
    found = repeated_lines(table(spark, [(i, f"s/{i}", "ab") for i in range(4)]), site(), "path", "text")
    odd = site_lines.SiteLines(found.lines.withColumn("bitmap", F.lit(b"\x05").cast("binary")), found.candidates, found.likely, found.hashed)
    assert sorted((r["__bit"], r["__holds"]) for r in odd.looked_up().collect()) == [(0, True), (1, False), (2, True), (3, False)]


def test_numbers_are_dense_and_distinct(spark):
    docs = spark.createDataFrame([("s", f"p{i}") for i in range(5000)], "source string, path string")
    numbers = sorted(r.container * site_lines.CONTAINER + r.bit for r in number_documents(docs).collect())
    assert numbers == list(range(5000))


def test_bits(spark):
    one = spark.createDataFrame([(i, bytearray(b"\x05\x80")) for i in range(20)], "i bigint, b binary")
    assert [r.i for r in one.where(holds_bit(F.col("b"), F.col("i"))).orderBy("i").collect()] == [0, 2, 15]


def test_nothing_and_long_texts(spark):
    assert mark_repeated(table(spark, []), site(), "path", "text").collect() == []
    rows = [(i, f"s/{i}", "x" * 200_000) for i in range(4)]
    assert mark_repeated(table(spark, rows), site(), "path", "text").count() == 4
