import pytest
from hypothesis import given
from hypothesis import strategies as st

from cuespark.llm.lookalike import canonical_form, find_lookalikes, phrase_blocks, skeletons, unify
from cuespark.llm.queries import p5_unified

PHRASES = [(0, "captions made by lanternloft"), (1, "coffee café of the final scene"), (2, "перевод проверен кружком"), (3, "más vídeo"), (4, " ")]
SAME = [
    (0, "Ｃａｐｔｉｏｎｓ made by lanternloft"), (0, "c\u200bap\u00adtions made by lanternloft"), (0, "captions\u00a0made\u2007by lanternloft"), (0, "𝐜𝐚𝐩𝐭𝐢𝐨𝐧𝐬 made by lanternloft"),
    (0, "сарtіоnѕ mаdе bу lаntеrnlоft"), (0, "CAPTIΟΝS MADE BY LANTERNLOFT"), (1, "coﬀee cafe\u0301 of the ﬁnal scene"), (2, "пepeвoд пpoвepeн кpyжкoм"), (2, "ПЕРЕВОД\u2003ПРОВЕРЕН КРУЖКОМ"),
    (3, "má\u2060s ví\u200cdeo"), (3, "mάs vídeo"), (0, "СAPTIONS MАDE ВY LANТERNLOFТ"),
]
OTHER = ["captions made by lanternloft", "CAPTIONS MADE BY LANTERNLOFT", "coffee cafe of the final scene", "mas vídeo", "captions mad by lanternloft", "перевод проверен кружкои", "", "\u200b", "привет"]


@pytest.mark.parametrize("query,text", SAME)
@pytest.mark.parametrize("whole", [True, False])
def test_looks_are_found(spark, query, text, whole):
    table = spark.createDataFrame([(7, text if whole else f"- {text}!", 1, "x")], "row_id bigint, search_text string, query_index int, text string")
    assert [tuple(r) for r in find_lookalikes(table, "row_id", "search_text", PHRASES, whole).collect()] == [(7, query)]


def test_others_are_not(spark):
    for whole in (True, False):
        table = spark.createDataFrame([(i, t) for i, t in enumerate([*OTHER, None])], "row_id bigint, search_text string")
        assert find_lookalikes(table, "row_id", "search_text", PHRASES, whole).collect() == []


def test_arrays_nulls_repeats_and_long_texts(spark):
    rows = [(1, None), (2, []), (3, [None, "mάs vídeo", "mάs vídeo"]), (3, ["mάs vídeo"]), (4, ["x mάs vídeo"]), (None, ["CAPTIΟΝS MADE BY LANTERNLOFT", "mάs vídeo"])]
    table = spark.createDataFrame(rows, "match_id bigint, matched_phrases array<string>")
    got = [tuple(r) for r in find_lookalikes(table, "match_id", "matched_phrases", PHRASES, True).collect()]
    assert sorted(got, key=str) == sorted([(3, 3), (3, 3), (None, 0), (None, 3)], key=str)
    long = spark.createDataFrame([(1, "á" * 300_000 + "mάs vídeo")], "row_id bigint, search_text string")
    assert find_lookalikes(long, "row_id", "search_text", PHRASES).count() == 1
    assert find_lookalikes(table, "match_id", "matched_phrases", [], True).count() == 0
    assert find_lookalikes(table.limit(0), "match_id", "matched_phrases", PHRASES, True).count() == 0


def test_own_characters_beside_a_look(spark):
    table = spark.createDataFrame([(1, "más vídeo and mάs vídeo")], "row_id bigint, search_text string")
    assert find_lookalikes(table, "row_id", "search_text", PHRASES).count() == 0


@given(st.text())
def test_forms_are_stable(text):
    once = canonical_form(text)
    assert canonical_form(once) == once
    assert skeletons(text.upper().lower())[1] == skeletons(text.upper().lower().upper())[1] or any(len(c.upper()) != 1 or len(c.lower()) != 1 or c.upper().lower() != c.lower() for c in text)


def test_unified_column(spark):
    table = spark.createDataFrame([(1, "Ｆｕｌｌ\u00a0 ﬁne Straße"), (2, None), (3, "")], "id int, text string")
    got = unify(table, "text", "u").orderBy("id").collect()
    assert [tuple(r)[2:] for r in got] == [("full fine strasse",) * 3, (None,) * 3, ("",) * 3]
    assert got[0].text == "Ｆｕｌｌ\u00a0 ﬁne Straße"


def test_unified_arrays(spark, tmp_path):
    rows = [(1, ["Ｆｕｌｌ", None, "ﬁne Straße"]), (2, None), (3, []), (4, ["mάs vídeo"])]
    table = spark.createDataFrame(rows, "match_id bigint, matched_phrases array<string>")
    got = unify(table, "matched_phrases", "u").orderBy("match_id").collect()
    assert [r.u for r in got] == [["full", None, "fine strasse"], None, [], [canonical_form("mάs vídeo")]]
    assert got[3].u_look == [skeletons("mάs vídeo")[0]] and got[3].u_capitals == [skeletons("mάs vídeo")[1]]
    table.write.parquet(f"{tmp_path}/json_cues.parquet")
    spark.createDataFrame([(7, "Ｆｕｌｌ"), (8, None)], "row_id bigint, search_text string").write.parquet(f"{tmp_path}/cues.parquet")
    found = sorted(((r.table_name, r.record_id, r.position, r.unified) for r in p5_unified(spark, str(tmp_path)).collect()), key=str)
    want = [("cues", 7, None, "full"), ("cues", 8, None, None), ("json_cues", 1, 0, "full"), ("json_cues", 1, 1, None), ("json_cues", 1, 2, "fine strasse"), ("json_cues", 4, 0, canonical_form("mάs vídeo"))]
    assert found == sorted(want, key=str)


def test_phrase_list(spark, monkeypatch):
    table = spark.createDataFrame([(1, "a"), (2, None)], "query_index int, query string")
    assert phrase_blocks(table, "query_index", "query") == [[(1, "a")]]
    assert phrase_blocks(table.limit(0), "query_index", "query") == [[]]
    monkeypatch.setattr("cuespark.llm.lookalike.MOST_PHRASES", 3)
    long = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "query_index int, query string")
    blocks = phrase_blocks(long, "query_index", "query")
    assert len(blocks) == 4 and sorted(x for b in blocks for x in b) == [(i, f"p{i}") for i in range(10)]


def test_letters_of_all_listed_scripts_look_latin():
    for letter, look in [("Ꭺ", "a"), ("ꭺ", "a"), ("ⲟ", "o"), ("Ⲥ", "c"), ("ꓐ", "b"), ("𐐬", "o"), ("𐐄", "o"), ("ჿ", "o"), ("ց", "g"), ("𐌀", "a"), ("ʙ", "b"), ("𐓪", "o")]:
        assert set(skeletons(letter)) & set(skeletons(look)), letter
