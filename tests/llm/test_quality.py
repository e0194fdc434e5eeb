import random

from cuespark.llm import quality
from cuespark.llm.quality import Counter, collect_common_words, merge_edges, text_statistics
from cuespark.llm.spoken import spoken_line, spoken_lines

COMMON = {"en": {"the", "and", "don't"}, "de": {"der", "und"}}
SCHEMA = "doc_id bigint, text string, lang string, format string, tokens int, edge string"


def statistics(spark, docs, **named):
    table = spark.createDataFrame([(*d, 1, "e") for d in docs], SCHEMA)
    return {r.doc_id: r for r in text_statistics(table, "doc_id", "text", "lang", "format", COMMON, **named).collect()}


def brute(text, lang, form):
    lines = spoken_lines(text, form)
    tokens = [t for x in lines for t in x.split()]

    def bare(t):
        t = t.lower()
        at = [i for i, c in enumerate(t) if c.isalnum()]
        return t[at[0] : at[-1] + 1].replace("’", "'") if at else ""

    known = set().union(*COMMON.values()) if lang is None else COMMON.get(lang, set())
    joined = "".join(tokens)
    return (len(tokens), len(joined), sum(not c.isalnum() for c in joined), len(lines), sum(x[-1] in ".!?…" for x in lines), sum(bare(t) in known for t in tokens))


def corpus():
    rng = random.Random(6)
    words = ["the", "THE,", "(and)", "Don’t", "der", "und…", "katze", "12", "--", "É!", "<i>x</i>", "-->", "7\n", "\n", "\n\n", "WEBVTT", "x" * 30, "\u00a0", "\u3000"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 200))), rng.choice(["en", "de", "ja", None]), rng.choice(["text", "srt", "webvtt", None])) for i in range(120)]
    return docs + [(200, "WEBVTT\n\n1\n00:01.000 --> 00:02.000\nHi the\n", "en", "webvtt"), (201, "", "en", "text"), (202, " \n ", "en", "srt"), (203, None, "en", "text"), (204, "the " * 30, "en", "text")]


def test_against_brute_force_at_any_chunk_size(spark):
    docs = corpus()
    for chunk, fan_in in ((1_000_000, 64), (7, 3), (50, 2)):
        quality.FAN_IN = fan_in
        got = statistics(spark, docs, chunk=chunk)
        assert set(got) == {d[0] for d in docs if d[1] is not None}
        for i, text, lang, form in docs:
            if text is not None:
                r = got[i]
                assert (r.tokens, r.token_chars, r.symbols, r.lines, r.ended, r.common) == brute(text, lang, form), (i, chunk)
    quality.FAN_IN = 64


def test_repeated_rows_and_ids_are_documents_of_their_own(spark):
    docs = [(1, "the cat\n" * 9, "en", "text"), (1, "the cat\n" * 9, "en", "text"), (1, "a dog\n" * 40, "en", "text"), (None, "x y\n" * 30, None, None), (None, "", None, None)]
    table = spark.createDataFrame([(*d, 1, "e") for d in docs], SCHEMA)
    for chunk in (5, 1_000):
        got = text_statistics(table, "doc_id", "text", "lang", "format", COMMON, chunk=chunk).select("doc_id", "tokens", "lines", "common").collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([(1, 18, 9, 9), (1, 18, 9, 9), (1, 80, 40, 0), (None, 60, 30, 0), (None, 0, 0, 0)], "doc_id int, tokens int, lines int, common int").collect())


def test_pieces_of_a_long_document_are_dealt_out(spark):
    """A document of many chunks: its pieces are in order and whole, also where a border cuts a character."""
    text = "".join(f"{i} é🎬\n" for i in range(30_000))
    r = statistics(spark, [(1, text, "en", "text")], chunk=64)[1]
    assert (r.tokens, r.lines, r.token_chars) == (60_000, 30_000, sum(len(str(i)) + 2 for i in range(30_000)))


def test_rules(spark):
    good = "The cat and the dog don't sleep and the bird sings.\n" * 4
    docs = [(1, good, "en", "text"), (2, "the the.", "en", "text"), (3, "a b c d. " * 10, "en", "text"), (4, "the ##### " * 20 + ".", "en", "text"), (5, good.replace(".", ""), "en", "text"), (6, good, "de", "text"), (7, "", "en", "text")]
    got = {i: list(r.broken) for i, r in statistics(spark, docs).items()}
    assert got == {1: [], 2: ["few_tokens"], 3: ["token_length", "common"], 4: ["symbols"], 5: ["endings"], 6: ["common"], 7: ["few_tokens"]}
    empty = statistics(spark, docs)[7]
    assert (empty.tokens, empty.mean_length, empty.ended_share) == (0, None, None)


def test_merging_is_associative():
    rng = random.Random(1)
    for _ in range(100):
        text = "".join(rng.choices("ab\n", k=40)).encode()
        parts = [text[i : i + 5] for i in range(0, 40, 5)]
        edges = []
        for i, p in enumerate(parts):
            head, *rest = p.split(b"\n")
            edges.append({"chunk": i, "last": i, "head": head, "tail": rest[-1] if rest else None, "broken": bool(rest)})
        inner = [x for p in parts for x in p.split(b"\n")[1:-1]]
        cut = rng.randrange(1, 8)
        left, one = merge_edges(edges[:cut])
        right, two = merge_edges(edges[cut:])
        whole, three = merge_edges([right, left])
        flat, four = merge_edges(edges)
        assert whole == flat and sorted(one + two + three) == sorted(four)
        ends = [flat["head"], *([flat["tail"]] if flat["broken"] else [])]
        assert sorted(inner + four + ends) == sorted(text.split(b"\n"))


def test_spoken_lines():
    assert spoken_lines("WEBVTT x\n\n 12 \n00:01 --> 00:02\n<v Bob>Hi</v> 3\n<1>\n5 < 6", "webvtt") == ["Hi 3", "5 < 6"]
    assert spoken_lines("WEBVTT x\n12\na --> b\n <i>c</i> ", "text") == ["WEBVTT x", "12", "a --> b", "<i>c</i>"]
    assert spoken_lines("x\nWEBVTT", "srt") == ["x", "WEBVTT"]
    assert spoken_line("<" * 300_000, True) == "<" * 300_000


def test_very_long_documents_and_common_words(spark):
    text = "the cat sat. " * 40_000 + "\n" + "x" * 100_000
    r = statistics(spark, [(1, text, "en", "text")], chunk=10_000)[1]
    assert (r.tokens, r.lines, r.ended, r.common) == (120_001, 2, 1, 40_000)
    table = spark.createDataFrame([("en", "the"), ("en", None), (None, "x"), ("de", "der")], "lang string, word string")
    assert collect_common_words(table) == {"en": {"the"}, "de": {"der"}}
    assert Counter({}).count(["a b"], "en")[:2] == [2, 2]
