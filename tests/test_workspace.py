"""Discovery, transactions, undo and recovery on real folders."""

import json
import os

import pytest

from cuespark.kernel import files as K
from cuespark.kernel import journal as J
from cuespark.kernel.formats import parse
from cuespark.operators.discovery import by_folded_path, cards, discover
from cuespark.workspace import RECOVERY, FilePlan, Plan, Workspace, WorkspaceError

CUE = "{n}\n00:00:0{n},000 --> 00:00:0{n},500\n{t}\n\n"


def body(*texts):
    return "".join(CUE.format(n=i, t=t) for i, t in enumerate(texts, 1)).encode()


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a.srt").write_bytes(body("one", "Straße", "three"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/_B.SRT").write_bytes(body("other", "one"))
    return tmp_path


def plan(root, at, ordinals, **changes):
    got = K.read_safe(str(root), at)
    cues = parse(got.data, "srt").cues
    return FilePlan(**({"path": at, "sha256": got.sha256, "identity": got.identity, "cue_ids": tuple(cues[i].cue_id for i in ordinals)} | changes))


def code(call, *args, **named):
    with pytest.raises(WorkspaceError) as e:
        call(*args, **named)
    return e.value.code


def test_tree_is_classified(spark, root, tmp_path):
    os.mkdir(root / ".hidden")
    (root / ".hidden/x.srt").write_bytes(body("x"))
    (root / ".file.srt").write_bytes(body("dot"))
    (root / "bad.srt").write_bytes(b"x\n")
    (root / "empty.vtt").write_bytes(b"WEBVTT\n")
    (root / "note.txt").write_bytes(b"x")
    os.symlink(root / "a.srt", root / "link.srt")
    os.symlink(root / "sub", root / "subdir")
    (root / "h1.srt").write_bytes(body("h"))
    os.link(root / "h1.srt", root / "h2.srt")
    os.mkfifo(root / "pipe.ass")
    with open(root / "huge.srt", "wb") as f:
        f.truncate(K.MOST_BYTES + 1)
    os.mkdir(root / "folder.srt")
    found = discover(spark, str(root))
    assert [r.path for r in by_folded_path(found.files.select("path")).collect()] == [".file.srt", "a.srt", "empty.vtt", "sub/_B.SRT"]
    assert {r.path: r.kind for r in found.issues.collect()} == {
        "bad.srt": "invalid", "link.srt": "symlink", "h1.srt": "hardlink", "h2.srt": "hardlink", "pipe.ass": "unsafe", "huge.srt": "too-large",
    }
    assert [(r.error_line, r.error) for r in found.issues.where("kind = 'invalid'").collect()] == [(1, "bad.srt:1: expected a numeric SRT cue ID")]
    cues = found.cues.where("path = 'a.srt'").orderBy("ordinal").collect()
    assert [(c.cue_id, c.search_text) for c in cues] == [("srt:0:37:0", "one"), ("srt:37:78:1", "strasse"), ("srt:78:117:2", "three")]
    assert found.files.where("path = 'empty.vtt'").first().cue_count == 0
    assert cards(found).count() == 10
    (root / "a.srt").write_bytes(b"")
    assert found.cues.where("path = 'a.srt'").count() == 3


def test_one_file(spark, root):
    assert [r.path for r in discover(spark, str(root), file="a.srt").files.collect()] == ["a.srt"]
    missing = discover(spark, str(root), file="no.srt")
    assert [(r.path, r.kind) for r in missing.issues.collect()] == [("no.srt", "unreadable")]
    for bad in ("../a.srt", "/a.srt", "a.txt", ""):
        with pytest.raises(Exception):
            discover(spark, str(root), file=bad)


def test_reading_refuses_links_on_the_way(root):
    os.symlink(root / "sub", root / "way")
    with pytest.raises(K.FileProblem) as e:
        K.read_safe(str(root), "way/_B.SRT")
    assert e.value.kind == "unsafe"
    with pytest.raises(K.FileProblem) as e:
        K.read_safe(str(root), "a.srt", sha256="0" * 64)
    assert e.value.kind == "conflict"


def test_apply_and_undo_keep_bytes_mode_and_time(root):
    os.chmod(root / "a.srt", 0o640)
    os.utime(root / "a.srt", ns=(10**18, 10**18))
    old = (root / "a.srt").read_bytes()
    w = Workspace(str(root))
    seen = []
    done = w.apply(Plan((plan(root, "a.srt", [1]), plan(root, "sub/_B.SRT", [1]))), lambda n, of, r: seen.append((n, of, r.status)))
    assert seen == [(1, 2, "succeeded"), (2, 2, "succeeded")]
    assert done.deleted_cues == 2 and done.undo_id.startswith("tx-") and not done.recovery_retained
    assert (root / "a.srt").read_bytes() == b"1\n00:00:01,000 --> 00:00:01,500\none\n\n2\n00:00:03,000 --> 00:00:03,500\nthree\n\n"
    info = os.stat(root / "a.srt")
    assert (info.st_mode & 0o777, info.st_mtime_ns) == (0o640, 10**18)
    assert w.undo_info().file_paths == ("a.srt", "sub/_B.SRT")
    assert not any(i.blocks_mutation for i in w.recoveries())
    assert code(w.undo, allowed=["a.srt"]) == "scope"
    assert code(w.undo, expected="tx-other") == "undo-changed"
    back = w.undo()
    assert back.count("restored") == 2 and not back.undo_id
    assert (root / "a.srt").read_bytes() == old
    assert code(w.undo) == "no-undo" and w.recoveries() == []


def test_a_later_change_supersedes_the_undo_point(root):
    w = Workspace(str(root))
    first = w.apply(Plan((plan(root, "a.srt", [0]),)))
    second = w.apply(Plan((plan(root, "a.srt", [0]),)))
    assert second.undo_id != first.undo_id and len(w.recoveries()) == 1
    w.undo()
    assert b"one" not in (root / "a.srt").read_bytes() and "Straße".encode() in (root / "a.srt").read_bytes()


def test_conflicts_and_empty_deletions_keep_the_undo_point(root):
    w = Workspace(str(root))
    first = w.apply(Plan((plan(root, "a.srt", [0]),)))
    kept = w.apply(Plan((plan(root, "sub/_B.SRT", []), plan(root, "a.srt", [0], sha256="0" * 64))))
    assert [r.status for r in kept.results] == ["skipped", "conflicted"] and kept.undo_id == first.undo_id
    same = plan(root, "a.srt", [0])
    data = (root / "a.srt").read_bytes()
    os.replace(root / "a.srt", root / "x")
    (root / "a.srt").write_bytes(data)
    assert [r.status for r in w.apply(Plan((same,))).results] == ["conflicted"]
    unknown = w.apply(Plan((plan(root, "a.srt", [0], cue_ids=("srt:0:1:9",)),)))
    assert [r.status for r in unknown.results] == ["failed"] and w.undo_info().id == first.undo_id
    twice = plan(root, "a.srt", [0])
    assert w.apply(Plan((FilePlan(twice.path, twice.sha256, twice.identity, twice.cue_ids * 2),))).deleted_cues == 2


def test_plans_are_checked(root):
    w = Workspace(str(root))
    w.revision = 3
    good = plan(root, "a.srt", [0])
    assert code(w.begin, Plan(())) == "empty-plan"
    assert code(w.begin, Plan((good,), revision=2)) == "stale-plan"
    assert code(w.begin, Plan((good, good))) == "duplicate-path"
    assert code(w.begin, Plan((plan(root, "a.srt", [0], identity=None),))) == "no-identity"
    assert code(w.begin, Plan((plan(root, "a.srt", [0], path="../a.srt"),))) == "unsafe-path"
    assert code(w.begin, Plan((plan(root, "a.srt", [0], path="a.txt"),))) == "unsupported"
    w.close()
    assert code(w.state) == "closed"


def test_one_writer(root):
    one, two = Workspace(str(root)), Workspace(str(root))
    t = one.begin(Plan((plan(root, "a.srt", [0]),)))
    assert code(two.state) == "locked" and code(one.state) == "locked"
    t.apply_one()
    t.finish()
    assert code(t.finish) == "closed"
    assert two.undo_info() is not None


def test_cancelled_changes_can_be_undone(root):
    w = Workspace(str(root))

    def stop(n, of, r):
        w.cancel = True

    done = w.apply(Plan((plan(root, "a.srt", [0]), plan(root, "sub/_B.SRT", [0]))), stop)
    assert [r.status for r in done.results] == ["succeeded", "not-attempted"] and done.cancelled and done.undo_id
    part = w.undo()
    assert part.cancelled and part.recovery_retained and w.recoveries()[0].status == "undo-partial"
    assert code(w.begin, Plan((plan(root, "a.srt", [0]),))) == "recovery-pending"
    w.cancel = False
    assert w.undo().count("restored") == 1


def crash(root, states, prepare=None):
    """A workspace whose transaction stopped after some files."""
    w = Workspace(str(root))
    t = w.begin(Plan((plan(root, "a.srt", [0]), plan(root, "sub/_B.SRT", [0]))))
    for _ in range(states):
        t.apply_one()
    if prepare:
        prepare(t)
    t.abandon()
    return w, t.manifest.id


def test_crash_before_any_change_is_retired(root):
    w, _ = crash(root, 0)
    assert w.recoveries() == [] and w.undo_info() is None


def test_crash_after_a_change_blocks_until_restored(root):
    old = (root / "a.srt").read_bytes()
    w, name = crash(root, 1)
    assert [(i.id, i.role, i.blocks_mutation) for i in w.recoveries()] == [(name, "pending", True)]
    assert code(w.begin, Plan((plan(root, "a.srt", [0]),))) == "recovery-pending"
    assert code(w.restore_recovery, name, allowed=["a.srt"]) == "scope"
    done = w.restore_recovery(name)
    assert [r.status for r in done.results] == ["restored", "skipped"]
    assert (root / "a.srt").read_bytes() == old and w.recoveries() == []


def test_discard_accepts_the_present_files(root):
    w, name = crash(root, 1)
    now = (root / "a.srt").read_bytes()
    w.discard_recovery(name)
    assert (root / "a.srt").read_bytes() == now and w.recoveries() == []
    assert code(w.discard_recovery, name) == "missing" and code(w.discard_recovery, "../x") == "unsafe-path"


def test_crash_after_everything_was_done_is_promoted(root):
    def complete(t):
        t.manifest.status = "complete"
        t.workspace._save(t.manifest)

    w, name = crash(root, 2, complete)
    assert w.undo_info().id == name and [i.role for i in w.recoveries()] == ["undo"]


def test_files_that_changed_since_are_not_restored(root):
    w, name = crash(root, 1)
    (root / "a.srt").write_bytes(body("mine"))
    done = w.restore_recovery(name)
    assert [r.status for r in done.results] == ["conflicted", "skipped"] and done.recovery_retained
    assert w.recoveries()[0].status == "recovery-partial"


def test_tampered_backup_fails_and_missing_target_conflicts(root):
    w = Workspace(str(root))
    name = w.apply(Plan((plan(root, "a.srt", [0]), plan(root, "sub/_B.SRT", [0])))).transaction_id
    at = root / RECOVERY / name / "backup/000000.bin"
    at.write_bytes(b"other")
    os.unlink(root / "sub/_B.SRT")
    assert [r.status for r in w.undo().results] == ["failed", "conflicted"]
    assert [i.status for i in w.recoveries()] == ["undo-partial"]


def test_orphans_and_corrupt_manifests_block(root):
    w, name = crash(root, 1)
    os.unlink(root / RECOVERY / "state.json")
    K.write_durably(str(root / RECOVERY), "state.json", J.dump(J.Pointers(generation=5)))
    assert [i.role for i in w.recoveries()] == ["orphan"]
    at = root / RECOVERY / name / "manifest.json"
    record = json.loads(at.read_bytes())
    for bad in (b"{", json.dumps(record | {"extra": 1}).encode(), json.dumps(record | {"id": "tx-other"}).encode(), at.read_bytes() + b"{}", json.dumps(record | {"entries": 0, "files": [{"path": "../x", "cue_ids": [], "original_sha256": ""}]}).encode(), json.dumps(record | {"entries": 9}).encode()):
        at.write_bytes(bad)
        assert [(i.role, i.corrupt) for i in w.recoveries()] == [("corrupt", True)]
        assert len(w.cleanup_session()) == 1
    assert code(w.restore_recovery, name) == "bad-state"
    w.discard_recovery(name)
    assert w.recoveries() == []


def test_state_that_cannot_be_read_stops_everything(root):
    w = Workspace(str(root))
    w.state()
    K.write_durably(str(root / RECOVERY), "state.json", b"{}x")
    assert code(w.state) == "bad-state"


def entry(state, backup="000000.bin"):
    return J.Entry("a.srt", ["x"], "0" * 64, backup=backup, state=state)


def test_settling_is_proven_by_records():
    def tx(n, status, *states, previous=""):
        return J.Manifest(f"tx-{n}", f"2030-01-0{n}", "all", previous, status, files=[entry(s) for s in states])

    one, two = tx(1, "complete", "committed"), tx(2, "complete", "committed", previous="tx-1")
    assert J.settle(J.Pointers(1, "tx-1", "tx-2"), {"tx-1": one, "tx-2": two}) == J.Pointers(1, "tx-2", "", ("tx-1",))
    assert J.settle(J.Pointers(1, "", "tx-2"), {"tx-2": two}) is None
    assert J.settle(J.Pointers(1, "", "tx-2"), {"tx-2": tx(2, "active", "prepared")}) is None
    assert J.settle(J.Pointers(1, "", "tx-2"), {"tx-2": tx(2, "active", "backed-up")}) == J.Pointers(1, "", "", ("tx-2",))
    assert J.settle(J.Pointers(1, "", "tx-2"), {"tx-2": tx(2, "complete", "failed", previous="tx-9")}) is None
    assert J.settle(J.Pointers(1), {"tx-3": tx(3, "complete", "failed")}) == J.Pointers(1, garbage=("tx-3",))
    assert J.settle(J.Pointers(1), {"tx-3": tx(3, "apply-partial", "prepared"), "tx-4": None}) is None
    assert J.adopt({"tx-1": one, "tx-2": two, "tx-3": tx(3, "active", "prepared"), "tx-4": tx(4, "active", "planned"), "tx-5": None}) == J.Pointers(
        current="tx-2", pending="tx-3", garbage=("tx-1", "tx-4")
    )
    assert J.after_restore(J.Pointers(1, "tx-1", "tx-2"), two, "pending") == J.Pointers(1, "tx-1", "", ("tx-2",))
    assert J.after_restore(J.Pointers(1, "tx-9", "tx-2"), two, "pending") == J.Pointers(1, "", "", ("tx-2", "tx-9"))
    assert J.after_discard(J.Pointers(1, "tx-1", "tx-2"), "tx-2") == J.Pointers(1, "", "", ("tx-1", "tx-2"))
    assert J.after_discard(J.Pointers(1, "tx-1", "tx-2"), "tx-7") == J.Pointers(1, "", "tx-2", ("tx-1", "tx-7"))
    assert J.after_discard(J.Pointers(1, "tx-1", "", ("tx-3",)), "tx-3") == J.Pointers(1, "tx-1")


def test_a_large_change_can_be_undone(tmp_path, monkeypatch):
    """20,000 files and a long list of cues: more than one record may hold."""
    monkeypatch.setattr(os, "fsync", lambda handle: None)
    count, text = 20_000, body("one", "two", "three")
    ids = [c.cue_id for c in parse(text, "srt").cues][:2]
    files = []
    for i in range(count):
        (tmp_path / f"{i}.srt").write_bytes(text)
        info = os.stat(tmp_path / f"{i}.srt")
        files.append(FilePlan(f"{i}.srt", K.hashlib.sha256(text).hexdigest(), ("unix", info.st_dev, info.st_ino), tuple(ids)))
    w = Workspace(str(tmp_path))
    done = w.apply(Plan(tuple(files)))
    assert done.count("succeeded") == count and not done.error
    at = tmp_path / RECOVERY / done.undo_id
    assert (at / "files.jsonl").stat().st_size + (at / "states.jsonl").stat().st_size > J.MOST_MANIFEST > (at / "manifest.json").stat().st_size
    again = Workspace(str(tmp_path))
    assert len(again.undo_info().file_paths) == count
    assert again.undo().count("restored") == count and (tmp_path / "77.srt").read_bytes() == text and again.recoveries() == []


def test_lists_of_cues_continue_on_further_lines():
    files = [J.Entry("a.srt", [f"srt:{i}" for i in range(25_000)], "0"), J.Entry("b.srt", [], "1")]
    lines = J.entry_lines(files).splitlines(keepends=True)
    assert len(lines) == 4 and J.load_entries(lines, [], 2) == files
    state = J.state_line(1, J.Entry("b.srt", [], "1", backup="000001.bin", state="prepared"))
    assert J.load_entries(lines, [state, state[:-5]], 2)[1].state == "prepared"
    for bad in (lines[1:], lines[:-1], [*lines, lines[0]], [b"{}\n"], [b"x"]):
        with pytest.raises(J.BadRecord):
            J.load_entries(bad, [], 2)
    with pytest.raises(J.BadRecord):
        J.load_entries(lines, [J.state_line(2, files[0])], 2)


def test_a_state_cut_short_by_a_crash_is_written_over(root):
    w, name = crash(root, 1)
    log = root / RECOVERY / name / "states.jsonl"
    log.write_bytes(log.read_bytes() + b'{"n":0,"st')
    assert [r.status for r in w.restore_recovery(name).results] == ["restored", "skipped"]
    assert w.recoveries() == []


def test_a_manifest_that_holds_its_files_is_read_and_restored(root):
    w, name = crash(root, 1)
    at = root / RECOVERY / name
    held = w._manifests()[0][name]
    record = json.loads((at / "manifest.json").read_bytes()) | {"entries": 0, "files": [vars(f) for f in held.files]}
    (at / "manifest.json").write_bytes(json.dumps(record).encode())
    os.unlink(at / "files.jsonl")
    os.unlink(at / "states.jsonl")
    assert [i.role for i in w.recoveries()] == ["pending"]
    assert [r.status for r in w.restore_recovery(name).results] == ["restored", "skipped"]


def test_scans_tell_their_progress(spark, root):
    said = []
    discover(spark, str(root), progress=lambda done, total: said.append((done, total)))
    assert said and said[-1][0] == said[-1][1] > 0 and all(a <= b for a, b in said)
