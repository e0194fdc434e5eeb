import itertools
import random

import pytest

from cuespark.llm import leaks
from cuespark.llm.leaks import EXACT_SEEDS, leaked_passages
from cuespark.llm.spoken import spoken_lines, words

SCHEMA = "doc_id bigint, text string, format string, item_id int, words string"


def find(spark, docs, items, substitutions=0, least=12, most_sent=leaks.MOST_SENT):
    table = spark.createDataFrame([(*d, 1, "w") for d in docs], SCHEMA)
    listed = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, doc_id string")
    return leaked_passages(table, "doc_id", "text", "format", listed, "item_id", "text", substitutions, least, most_sent).collect()


def brute(docs, items):
    out = set()
    for d, t, f in docs:
        w = words(" ".join(spoken_lines(t, f))) if t is not None else []
        own = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, x in items:
            v = words(x)
            if any(tuple(v[j : j + 12]) in own for j in range(len(v) - 11)):
                out.add((d, i))
    return out


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Ж", "naïve"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 30, 60])))) for i in range(40)]
    items += [(90, items[3][1]), (91, "")]
    docs = []
    for d in range(150):
        body = rng.choices(vocabulary, k=80)
        if d % 3 == 0:
            piece = words(rng.choice(items)[1])
            n = rng.choice([11, 12, 20])
            body[30:30] = [x.upper() for x in piece[:n]]
        form = rng.choice(["text", "srt", "webvtt", None])
        lines = [" ".join(body[i : i + 7]) + "," for i in range(0, len(body), 7)]
        if form in ("srt", "webvtt"):
            lines = [y for i, x in enumerate(lines) for y in (str(i + 1), "00:00:01,000 --> 00:00:02,000", f"<i>{x}</i>", "")]
        docs.append((d, "\n".join(lines), form))
    return docs + [(200, None, "text"), (201, "", "text"), (202, docs[0][1], docs[0][2])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items)
    assert want
    monkeypatch.setattr(leaks, "GROUP", 2)
    for most in (leaks.MOST_SENT, 0):
        for substitutions in (0, 1):
            got = find(spark, docs, items, substitutions, most_sent=most)
            assert {(r.doc_id, r.item_id) for r in got if r.run >= 12} == want


def test_both_ways_give_the_same_rows(spark):
    docs, items = corpus()
    hit = next(d for d in docs if d[0] in {x for x, _ in brute(docs, items)})
    docs += [(None, *hit[1:]), (3, *hit[1:]), hit]
    items += [(3, items[7][1]), (None, items[8][1]), items[8]]
    key = lambda rows: sorted(map(str, rows))
    sent = find(spark, docs, items, 1)
    assert any(r.doc_id is None for r in sent) and key(sent) == key(find(spark, docs, items, 1, most_sent=0))


def test_passages_are_whole(spark):
    item = " ".join(f"w{i}" for i in range(40))
    got = find(spark, [(1, "x y " + " ".join(f"W{i}" for i in range(5, 35)) + " z", "text")], [(7, item)])
    assert [tuple(r) for r in got] == [(1, 7, 2, 5, 30, 0, 30)]


def test_substitutions_are_tolerated(spark):
    item = [f"w{i}" for i in range(40)]
    changed = list(item)
    for i in (4, 11, 19, 27, 33):
        changed[i] = "other"
    docs = [(1, " ".join(changed), "text")]
    assert find(spark, docs, [(7, " ".join(item))]) == []
    assert [(r.words, r.substituted) for r in find(spark, docs, [(7, " ".join(item))], 1)] == [(40, 5)]


def stretches(document, item, substitutions, least):
    """Every passage of the definition, by comparing on all diagonals."""
    out = set()
    for shift in range(1 - len(item), len(document)):
        same = [p for p in range(max(0, shift), min(len(document), len(item) + shift)) if document[p] == item[p - shift]]
        groups = []
        for p in same:
            if groups and p - groups[-1][-1] <= substitutions + 1:
                groups[-1].append(p)
            else:
                groups.append([p])
        out |= {(g[0], g[0] - shift, g[-1] - g[0] + 1, g[-1] - g[0] + 1 - len(g)) for g in groups if len(g) >= least}
    return out


@pytest.mark.parametrize("substitutions,least", [(0, 12), (1, 12), (2, 12), (1, 5), (0, 4)])
def test_every_passage_of_the_definition_is_found(spark, substitutions, least):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(40)]
    docs = [(1, [w if i % 4 else "x" for i, w in enumerate(item)]), (2, [w if i % 2 else "x" for i, w in enumerate(item)]), (3, [w if i % 3 else "x" for i, w in enumerate(item)])]
    for d in range(4, 120):
        changed = [w if rng.random() > rng.choice([0.1, 0.3, 0.5]) else "x" for w in item]
        docs.append((d, ["y"] * rng.randrange(5) + changed[rng.randrange(10) : rng.randrange(20, 41)]))
    want = {(d, *s) for d, w in docs for s in stretches(w, item, substitutions, least)}
    assert want or (substitutions, least) == (0, 12)
    for most in (leaks.MOST_SENT, 0):
        got = find(spark, [(d, " ".join(w), "text") for d, w in docs], [(7, " ".join(item))], substitutions, least, most)
        assert sorted((r.doc_id, r.doc_word, r.item_word, r.words, r.substituted) for r in got) == sorted(want)


def test_every_stretch_holds_a_near_seed():
    for gaps in itertools.product((0, 1), repeat=11):
        stretch = "1" + "".join("0" * g + "1" for g in gaps)
        assert any(all(stretch[at + i] == "1" for i, b in enumerate(s) if b == "1") for s in leaks.NEAR_SEEDS for at in range(len(stretch) - len(s) + 1))


def test_exact_passages_come_from_a_spaced_seed(spark):
    assert all("0" in s for s in leaks.seeds_for(0))
    item = [f"w{i}" for i in range(12)]
    near = [w if EXACT_SEEDS[0][i] == "1" else "other" for i, w in enumerate(item)]
    assert [r.doc_id for r in find(spark, [(1, " ".join(item), "text"), (2, " ".join(near), "text")], [(7, " ".join(item))])] == [1]


def test_nothing_and_very_long_texts(spark):
    assert find(spark, [], [(1, "a " * 20)]) == []
    assert find(spark, [(1, "a " * 20, "text")], []) == []
    assert find(spark, [(1, "a " * 20, "text")], [(1, None), (2, "")], most_sent=-1) == []
    long = "<" * 200_000 + " " + " ".join(f"w{i}" for i in range(150_000))
    got = find(spark, [(1, long, "srt"), (2, "x" * 500_000, "text")], [(7, " ".join(f"w{i}" for i in range(70_000, 70_020)))])
    assert [(r.doc_id, r.words) for r in got] == [(1, 20)]
