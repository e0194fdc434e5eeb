from cuespark.plans.tree_queries import ISSUE_KINDS, QUERIES


def test_each_kind_is_found(spark, tmp_path):
    paths = ["d/" + "x" * n + ".srt" for n in range(1, 7)]
    rows = [(i, p, "c0", 0, 0, 10, "text") for i, p in enumerate(paths)]
    spark.createDataFrame(rows, "row_id bigint, path string, cue_id string, ordinal int, start_ms bigint, end_ms bigint, display_text string").write.parquet(f"{tmp_path}/cues.parquet")
    got = sorted(map(tuple, QUERIES["tree_issue_kinds"](spark, str(tmp_path)).collect()))
    assert got == sorted((p, ISSUE_KINDS[len(p) % 6]) for p in paths if len(p) % 6)
    assert len(got) == 5
