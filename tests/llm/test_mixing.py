import random

import pytest
from pyspark.sql import functions as F

from cuespark.llm import mixing
from cuespark.llm.mixing import count_tokens, draw_order, mix, mix_report, source_plan, systematic_copies

TARGETS = [("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.0, 4), ("none", 0.1, 2)]


@pytest.fixture
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def documents(spark, n=400):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "c", "c", "c", "unlisted", None]), " ".join(rng.choices(["the", "cat", "über", "Лодка", "12", "\n\n"], k=rng.randrange(40))), 1) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "a", None, 1), (n + 1, "a", "", 1), (5, rows[5][1], rows[5][2], 1)], "doc_id bigint, source string, text string, tokens int")


def test_pieces_have_the_tokens_of_the_whole(monkeypatch):
    rng = random.Random(1)
    encode = mixing._encoder(mixing.VOCABULARY).encode_ordinary
    for size in (5, 40, 200):
        monkeypatch.setattr(mixing, "PIECE", size)
        for _ in range(60):
            text = "".join(rng.choices(["word", " ", "  ", "\n", "it's", ".", "7", "é", "Ж", "🎬", "\u3000"], k=300))
            parts = list(mixing._pieces(text))
            assert "".join(parts) == text
            assert [t for p in parts for t in encode(p)] == encode(text)


def test_token_counts(spark):
    table = spark.createDataFrame([(1, "a cat sat", "x"), (2, None, "y"), (3, "", None), (4, "<|endoftext|>", "z")], "id int, text string, extra string")
    encode = mixing._encoder(mixing.VOCABULARY).encode_ordinary
    got = {r.id: (r.n, r.extra) for r in count_tokens(table, "text", "n").collect()}
    assert got == {1: (len(encode("a cat sat")), "x"), 2: (0, "y"), 3: (0, None), 4: (len(encode("<|endoftext|>")), "z")}


def test_plan_against_brute_force(spark, targets):
    sized = count_tokens(documents(spark).select("doc_id", "source", "text"), "text", "tokens")
    sizes = {}
    for r in sized.collect():
        sizes[r.source] = sizes.get(r.source, 0) + r.tokens
    total = sum(sizes.get(s, 0) for s, _, _ in TARGETS)
    for r in source_plan(sized, targets).collect():
        share, most = next((b, c) for a, b, c in TARGETS if a == r.source)
        size = sizes.get(r.source, 0)
        assert (r["size"], r.total, r.short) == (size, total, size * most < share * total)
        assert r.rate == pytest.approx(min(share * total, size * most) / size if size else 0)


def test_copies_are_systematic(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 10 else "cold", rng.choice([0.0, 0.25, 0.9, 1.0, 2.6]), "x") for i in range(5000)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, expected double, __x string").drop("__x")
    drawn = systematic_copies(table, "source", draw_order(F.col("doc_id"), 7), F.col("expected"), 1, "copies").collect()
    assert len(drawn) == len(rows)
    for r in drawn:
        assert int(r.expected) <= r.copies <= int(r.expected) + (r.expected % 1 > 0)
    for s in ("hot", "cold"):
        assert abs(sum(r.copies for r in drawn if r.source == s) - sum(r.expected for r in drawn if r.source == s)) < 1 + 1e-3
    again = systematic_copies(table.repartition(7), "source", draw_order(F.col("doc_id"), 7), F.col("expected"), 1, "copies").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_more_copies_than_an_int_holds(spark):
    rows = [(i, "a", e) for i, e in enumerate([2e9, 2_000_000_000.5, 0.25, 1e9, 0.75, 2e9])]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, expected double")
    drawn = systematic_copies(table, "source", draw_order(F.col("doc_id"), 7), F.col("expected"), 1, "copies").collect()
    assert all(abs(r.copies - r.expected) < 1 for r in drawn)
    assert abs(sum(r.copies for r in drawn) - sum(r[2] for r in rows)) < 1


def test_mix_and_report(spark, targets):
    docs = documents(spark)
    mixed = mix(docs, "doc_id", "text", targets).collect()
    assert mixed and {r.source for r in mixed} <= {"a", "b", "c"}
    assert all(r.copies <= dict((a, c) for a, _, c in TARGETS)[r.source] for r in mixed)
    report = {r.source: r for r in mix_report(docs, "doc_id", "text", targets).collect()}
    assert set(report) == {t[0] for t in TARGETS}
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    for s, r in report.items():
        assert r.mixed_tokens == sum(m.tokens * m.copies for m in mixed if m.source == s)
        assert r.short == (s == "none" or r["size"] * r.max_repeats < r.target_share * sum(x["size"] for x in report.values()))


def test_empty_tables(spark, targets):
    assert mix(documents(spark).limit(0), "doc_id", "text", targets).collect() == []
    assert mix_report(documents(spark), "doc_id", "text", targets.limit(0)).collect() == []
