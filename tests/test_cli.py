"""Commands, sessions, SQL functions and streams."""

import io
import json
import os
import signal

import pyarrow as pa
import pytest

from cuespark import output as O
from cuespark.cli import run
from cuespark.operators.plan import conflicts, plan_faults, plan_files
from cuespark.session import Session
from cuespark.sources.subtitles import SubtitleReader, SubtitleStream, _Settings
from cuespark.sql import register_functions, register_views
from cuespark.streaming import match_stream, stream_files
from cuespark.workspace import Workspace, WorkspaceError

CUE = "{n}\n00:00:0{n},000 --> 00:00:0{n},500\n{t}\n\n"


def body(*texts):
    return "".join(CUE.format(n=i, t=t) for i, t in enumerate(texts, 1)).encode()


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a.srt").write_bytes(body("Thanks for watching", "keep", "thanks FOR watching, Bob"))
    (tmp_path / "b.vtt").write_bytes(b"WEBVTT\n\n00:01.000 --> 00:02.000\nkeep\n")
    return tmp_path


@pytest.fixture
def command(spark):
    def call(*args):
        out, err = io.StringIO(), io.StringIO()
        return run(list(args), lambda: spark, out, err), out.getvalue(), err.getvalue()

    return call


@pytest.mark.parametrize(
    "args",
    [
        [], ["scan"], ["what"], ["scan", "-d"], ["scan", "-d", ""], ["scan", "-d", "/nowhere"], ["scan", "-d", "/tmp", "-f", "a.srt"], ["scan", "-d", "/tmp", "-d", "/tmp"],
        ["scan", "-d", "/tmp", "x"], ["scan", "-d", "/tmp", "--dry-run"], ["scan", "-d", "/tmp", "--json", "-q"], ["search", "-d", "/tmp"], ["search", "-d", "/tmp", " "],
        ["scan", "-f", "/tmp/a.txt"], ["scan", "-f", "/nowhere/a.srt"], ["recovery"], ["recovery", "list", "-d", "/tmp", "x"], ["recovery", "restore", "-d", "/tmp"], ["recovery", "x", "-d", "/tmp"],
        ["scan", "--js", "-d", "/tmp"],
    ],
)
def test_wrong_usage(command, args):
    code, out, err = command(*args)
    assert code == 2 and not out and err.startswith("cuespark: ")


def test_version_and_help(command, capsys):
    assert command("version")[:2] == (0, "0.1.0\n")
    assert command("--help")[0] == 0 and command("remove", "--help")[0] == 0
    assert "usage: cuespark" in capsys.readouterr().out


def test_scan(command, root):
    code, out, err = command("scan", "-d", str(root))
    assert (code, err) == (0, "")
    assert out == "FILE a.srt  format=srt encoding=utf-8 cues=3 size=149\nFILE b.vtt  format=webvtt encoding=utf-8 cues=1 size=37\nSUMMARY files=2 issues=0\n"
    (root / "bad.srt").write_bytes(b"x\x1b")
    code, out, err = command("scan", f"--directory={root}", "--json")
    document = json.loads(out)
    assert code == 4 and document["status"] == "partial" and document["summary"] == {"files": 2, "issues": 1}
    assert document["issues"] == [{"path": "bad.srt", "kind": "invalid", "error": "bad.srt:1: expected a numeric SRT cue ID"}]
    assert list(document) == ["schema_version", "command", "status", "root", "target", "summary", "files", "issues"]
    code, out, err = command("scan", "-f", str(root / "no.srt"))
    assert code == 4 and err.startswith("ISSUE no.srt  unreadable: ")


def test_empty_results_are_arrays(command, tmp_path):
    code, out, _ = command("search", "-d", str(tmp_path), "--json", "x")
    document = json.loads(out)
    assert code == 1 and document["status"] == "empty" and document["matches"] == document["issues"] == []
    assert document["summary"] == {"matching_cues": 0, "matching_files": 0, "scanned_files": 0, "skipped_files": 0}


def test_search_remove_undo(command, root):
    old = (root / "a.srt").read_bytes()
    code, out, err = command("search", "-d", str(root), "--", "watching", " WATCHING ", "bob")
    assert code == 0 and err == ""
    assert out.splitlines() == [
        "MATCH a.srt  00:00:01.000 --> 00:00:01.500  Thanks for watching  phrases=watching",
        "MATCH a.srt  00:00:03.000 --> 00:00:03.500  thanks FOR watching, Bob  phrases=watching,bob",
        "SUMMARY cues=2 files=1 scanned=2 issues=0",
    ]
    code, out, _ = command("remove", "-d", str(root), "--dry-run", "--json", "watching")
    document = json.loads(out)
    assert code == 0 and document["dry_run"] is True and document["command"] == "remove" and len(document["matches"]) == 2 and document["queries"] == ["watching"]
    assert document["matches"][0] == {"path": "a.srt", "id": "srt:0:53:0", "start_ms": 1000, "end_ms": 1500, "text": "Thanks for watching", "matched_phrases": ["watching"]}
    assert (root / "a.srt").read_bytes() == old
    code, out, _ = command("remove", "-f", str(root / "a.srt"), "--json", "watching")
    document = json.loads(out)
    assert code == 0 and document["summary"]["deleted_cues"] == 2 and document["undo"]["available"] and document["results"] == [{"path": "a.srt", "status": "succeeded", "deleted_cues": 2}]
    assert (root / "a.srt").read_bytes() == b"1\n00:00:02,000 --> 00:00:02,500\nkeep\n\n"
    assert command("remove", "-d", str(root), "watching")[0] == 1
    code, out, _ = command("recovery", "list", "-f", str(root / "b.vtt"))
    assert (code, out) == (0, "SUMMARY recoveries=0\n")
    code, out, _ = command("recovery", "list", "-d", str(root), "--json")
    assert code == 0 and json.loads(out)["recoveries"][0]["file_paths"] == ["a.srt"]
    assert command("undo", "-f", str(root / "b.vtt"))[0] == 3
    code, out, _ = command("undo", "-d", str(root))
    assert code == 0 and out.startswith("RESTORED a.srt\nSUMMARY action=undo succeeded=0 restored=1 ")
    assert (root / "a.srt").read_bytes() == old
    code, out, err = command("undo", "-d", str(root))
    assert code == 1 and err
    assert command("recovery", "discard", "-d", str(root), "tx-none")[0] == 3
    assert command("scan", "-d", str(root), "-q") == (0, "", "")


def test_documents_hide_nothing(command):
    text = O.to_json({"a": "\u202e\x9b\x7f\u2028<&>\n"})
    assert text == '{"a":"\\u202e\\u009b\\u007f\\u2028<&>\\n"}\n' and json.loads(text) == {"a": "\u202e\x9b\x7f\u2028<&>\n"}
    assert O.sanitize("a\x1b[31m\u202eb\n") == "a�[31m�b�"
    assert O.shell_quote("it's") == "'it'\\''s'"


def refused(call, *args):
    with pytest.raises(WorkspaceError) as e:
        call(*args)
    return e.value.code


def test_only_reviewed_matches_may_be_removed(spark, root):
    s = Session(spark, Workspace(str(root)))
    assert refused(s.search, ["x"]) == "no-scan"
    s.discover()
    review = s.search(["watching"])
    ask = lambda *rows: spark.createDataFrame([*rows], "path string, cue_ids array<string>")
    good = [r.cue_id for r in review.matches.orderBy("ordinal").collect()]
    s.check_request(ask(("a.srt", good)), review)
    for rows in ([("a.srt", ["srt:53:91:1"])], [("a.srt", good[:1] * 2)], [("a.srt", [])], [("c.srt", good)], [("a.srt", good), ("a.srt", good)]):
        assert refused(s.check_request, ask(*rows), review) == "not-reviewed"
    s.search(["keep"])
    assert refused(s.plan, review) == "stale-plan"
    review = s.search(["watching"])
    planned = s.plan(review, spark.createDataFrame([("b.vtt",)], "path string"))
    assert planned.files == ()
    files = s.found.files
    now = files.withColumn("sha256", files.path)
    assert [r.status for r in conflicts(plan_files(review.matches, files, "all", 1), now).collect()] == ["conflicted"]
    assert plan_faults(plan_files(review.matches, files, "all", 1), files, review.matches).count() == 0
    with pytest.raises(ValueError):
        plan_files(review.matches, files, "some", 1)
    s.discover()
    assert refused(s.plan, review) == "stale-plan"


def test_editor_tokens_are_used_once(spark, root):
    s = Session(spark, Workspace(str(root)))
    s.discover()
    opened = s.open_editor("a.srt")
    assert opened.token.startswith("editor-") and len(opened.token) == 39
    assert s.search_editor(opened.token, " ").count() == 3 and s.search_editor(opened.token, "keep").count() == 1
    cue = [r.cue_id for r in opened.cues.where("ordinal = 1").collect()]
    assert refused(s.remove_in_editor, opened.token, "b.vtt", cue) == "wrong-path"
    assert refused(s.remove_in_editor, opened.token, "a.srt", []) == "bad-cues"
    assert refused(s.remove_in_editor, opened.token, "a.srt", cue * 2) == "bad-cues"
    assert refused(s.remove_in_editor, opened.token, "a.srt", ["x"]) == "not-reviewed"
    assert refused(s.remove_in_editor, "editor-forged", "a.srt", cue) == "stale-token"
    assert refused(s.remove_in_editor, "", "a.srt", cue) == "no-token"
    assert s.remove_in_editor(opened.token, "a.srt", cue).deleted_cues == 1
    assert refused(s.remove_in_editor, opened.token, "a.srt", cue) == "stale-token"
    assert refused(s.open_editor, "no.srt") == "not-indexed"


def test_sql_functions_and_views(spark, root):
    register_functions(spark)
    found = Session(spark, Workspace(str(root))).discover()
    register_views(found)
    assert spark.sql("select count(*) from cues where normalize_search(display_text) like '%watching%'").first()[0] == 2
    assert spark.sql("select project_markup('<b>x</b>&amp;'), project_ass('{a}b'), normalize_display(' a  b'), normalize_search(null)").first()[:] == ("x&", "b", "a b", None)
    content = body("one", "two")
    spark.createDataFrame([(bytearray(content), "srt"), (bytearray(b"x"), "srt")], "content binary, form string").createOrReplaceTempView("raw")
    got = spark.sql("select c.ordinal, c.display_text, c.error from raw, lateral parse_cues(content, form) c order by c.ordinal").collect()
    assert [tuple(r) for r in got] == [(None, None, "1: expected a numeric SRT cue ID"), (0, "one", None), (1, "two", None)]
    made = spark.sql("select render_deletion(content, form, array('srt:0:37:0')) r from raw").collect()
    assert [r.r and bytes(r.r) for r in made] == [b"1\n00:00:02,000 --> 00:00:02,500\ntwo\n\n", None]


def test_stream_of_files(spark, root, tmp_path_factory):
    kept = str(tmp_path_factory.mktemp("kept"))
    stream = lambda: match_stream(stream_files(spark, str(root)), ["watching"]).select("path", "ordinal")

    def drain():
        q = stream().writeStream.format("parquet").option("path", f"{kept}/out").option("checkpointLocation", f"{kept}/log").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(f"{kept}/out").collect())

    assert drain() == [("a.srt", 0), ("a.srt", 2)]
    (root / "new.srt").write_bytes(body("watching you"))
    assert drain() == [("a.srt", 0), ("a.srt", 2), ("new.srt", 0)]


def test_an_interrupt_ends_a_change_between_files(spark, root, monkeypatch):
    """The file under way is finished, the rest is not attempted, the document is printed, and nothing is left pending."""
    (root / "c.srt").write_bytes(body("Thanks for watching", "keep"))
    from cuespark.workspace import Transaction

    apply_one = Transaction.apply_one

    def interrupted(self):
        os.kill(os.getpid(), signal.SIGINT)
        return apply_one(self)

    monkeypatch.setattr(Transaction, "apply_one", interrupted)
    before = signal.getsignal(signal.SIGINT)
    out = io.StringIO()
    code = run(["remove", "-d", str(root), "--json", "thanks for watching"], lambda: spark, out, io.StringIO())
    document = json.loads(out.getvalue())
    assert code == O.INTERRUPTED and document["status"] == "interrupted"
    assert [r["status"] for r in document["results"]] == ["succeeded", "not-attempted"] and document["summary"]["cancelled"]
    assert signal.getsignal(signal.SIGINT) == before
    workspace = Workspace(str(root))
    assert [i.role for i in workspace.recoveries()] == ["undo"] and not workspace.state().blocked
    monkeypatch.undo()
    assert run(["undo", "-d", str(root), "-q"], lambda: spark, out, io.StringIO()) == O.PARTIAL  # one file had nothing to restore
    assert (root / "a.srt").read_bytes() == body("Thanks for watching", "keep", "thanks FOR watching, Bob")


def test_help_topics_and_colour(command, root, spark, capsys):
    assert command("help")[0] == 0 and command("help", "recovery", "restore")[0] == 0
    assert "usage: cuespark recovery restore" in capsys.readouterr().out
    assert command("help", "what")[0] == 2

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    out = Terminal()
    run(["search", "-d", str(root), "thanks"], lambda: spark, out, io.StringIO())
    assert "\x1b[32mMATCH\x1b[0m" in out.getvalue()


def test_offsets_of_a_stream_do_not_grow_with_the_tree(root):
    reader = SubtitleStream(_Settings({"root": str(root)}))
    sizes, offsets = [], [reader.initialOffset()]
    for i in range(300):
        if i in (0, 10, 299):
            offsets.append(reader.latestOffset())
            sizes.append(len(json.dumps(offsets[-1])))
        (root / f"n{i}.srt").write_bytes(body("x"))
    assert len(set(sizes)) == 1 and reader.latestOffset() == reader.latestOffset()
    parts = lambda a, b: sorted(f.path for p in reader.partitions(a, b) for f in p.entries)
    assert parts(offsets[0], offsets[1]) == ["a.srt", "b.vtt"]
    assert parts(offsets[1], offsets[2]) == sorted(f"n{i}.srt" for i in range(10))
    reader.commit(offsets[2])
    assert len(parts(offsets[2], offsets[3])) == 289


def test_a_name_that_is_no_text_is_an_issue(root, spark):
    from cuespark.operators import discovery

    with open(os.fsencode(root) + b"/\xff.srt", "wb") as f:
        f.write(body("x"))
    assert [(r.path, r.kind) for r in discovery.discover(spark, str(root)).issues.collect()] == [("�.srt", "unsafe")]


def test_the_source_gives_arrow_batches(root, spark):
    from cuespark.operators import discovery

    settings = _Settings({"root": str(root), "content": "true"})
    batches = [b for p in settings.plan() for b in SubtitleReader(settings).read(p)]
    assert all(isinstance(b, pa.RecordBatch) for b in batches) and sum(b.num_rows for b in batches) == 2
    plain = {r.path: (r.sha256, len(r.cues), bytes(r.content)) for r in spark.read.format("subtitles").option("root", str(root)).option("content", "true").load().collect()}
    found = discovery.discover(spark, str(root), content=True).scanned
    assert plain == {r.path: (r.sha256, len(r.cues), bytes(r.content)) for r in found.collect()}
