"""Phrases of every script, against brute force."""

from cuespark.kernel.texts import normalize_search
from cuespark.plans.reference_queries import phrase_dedupe_all

ROWS = [
    (3, ["CAFÉ", "café"]), (1, ["Straße", None, " "]), (2, ["STRASSE", "перевод"]), (5, None), (4, ["ПЕРЕВОД", "字幕", "plain  words"]), (6, ["Plain Words", "ὈΔΟΣ", "ὀδοσ", "ﬁne", "FINE"]), (7, ["сaption", "caption"]), (8, []),
]


def test_phrases_beyond_ascii_take_part(spark, tmp_path):
    spark.createDataFrame(ROWS, "match_id bigint, matched_phrases array<string>").write.parquet(f"{tmp_path}/json_cues.parquet")
    first = {}
    for _, phrases in sorted(ROWS, key=lambda r: r[0]):
        for p in phrases or []:
            if p is not None and normalize_search(p):
                first.setdefault(normalize_search(p), p)
    got = sorted(tuple(r) for r in phrase_dedupe_all(spark, str(tmp_path)).collect())
    assert got == [(i, p, n) for i, (n, p) in enumerate(first.items())]
    assert len(got) == 9
