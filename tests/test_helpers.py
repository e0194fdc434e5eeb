"""Changes of many files by several processes, against the same changes one by one."""

import os
import time

import pytest

from cuespark import workspace as W
from cuespark.kernel import changes as C
from cuespark.kernel import files as K
from cuespark.kernel import journal as J
from cuespark.kernel.formats import parse
from cuespark.workspace import FilePlan, Plan, Workspace

CUE = "{n}\n00:00:0{n},000 --> 00:00:0{n},500\n{t}\n\n"
FILES = 30


@pytest.fixture(params=[1, 10_000])
def made(request, monkeypatch, tmp_path):
    monkeypatch.setattr(W, "HELPED_FROM", request.param)
    plans = []
    for i in range(FILES):
        (tmp_path / f"{i:02d}.srt").write_bytes("".join(CUE.format(n=n, t=f"cue {n} of {i}") for n in (1, 2, 3)).encode())
        got = K.read_safe(str(tmp_path), f"{i:02d}.srt")
        plans.append(FilePlan(f"{i:02d}.srt", got.sha256, got.identity, J.CueIds(c.cue_id for c in parse(got.data, "srt").cues[: 1 + i % 3])))
    return tmp_path, Plan(tuple(plans))


def test_files_are_changed_and_put_back(made):
    root, plan = made
    before = {p: (root / p).read_bytes() for p in os.listdir(root)}
    (root / "03.srt").write_bytes(b"changed since")
    os.unlink(root / "04.srt")
    told = []
    space = Workspace(str(root))
    done = space.apply(plan, lambda n, total, r: told.append((n, total, r.path)))
    assert told == [(n + 1, FILES, f"{n:02d}.srt") for n in range(FILES)]
    expected = {3: ("conflicted", 0), 4: ("failed", 0)}
    assert [(r.path, r.status, r.deleted_cues) for r in done.results] == [(f"{i:02d}.srt", *expected.get(i, ("succeeded", 1 + i % 3))) for i in range(FILES)]
    assert b"cue 1 of 6" not in (root / "06.srt").read_bytes() and b"cue 2 of 6" in (root / "06.srt").read_bytes()
    assert [(i.role, i.status, i.changed) for i in space.recoveries()] == [("undo", "complete", FILES - 1)]
    back = space.undo()
    assert [r.status for r in back.results] == [{3: "skipped", 4: "skipped"}.get(i, "restored") for i in range(FILES)] and space.recoveries() == []
    assert all((root / p).read_bytes() == x for p, x in before.items() if p not in ("03.srt", "04.srt"))


def test_what_is_under_way_is_finished(made, monkeypatch):
    monkeypatch.setattr(C, "AHEAD", 8)  # else all may be done before the first is told
    root, plan = made
    before = {p: (root / p).read_bytes() for p in os.listdir(root)}
    space = Workspace(str(root))
    done = space.apply(plan, lambda n, total, r: setattr(space, "cancel", True))
    statuses = [r.status for r in done.results]
    changed = statuses.count("succeeded")
    assert done.cancelled and 0 < changed < FILES and statuses == ["succeeded"] * changed + ["not-attempted"] * (FILES - changed)
    assert [(root / p).read_bytes() != before[p] for p in sorted(before)] == [True] * changed + [False] * (FILES - changed)
    space.cancel = False
    assert space.undo().count("restored") == changed and {p: (root / p).read_bytes() for p in before} == before


def test_packed_ids_are_those_of_the_tuple():
    ids = ("srt:1:2:3", "é\n\"", "x")
    assert J.CueIds(ids) == ids and (len(J.CueIds(ids)), J.CueIds(ids)[1], *J.CueIds(ids)) == (3, ids[1], *ids) and hash(J.CueIds(ids)) == hash(ids)
    lines = J.entry_lines([J.Entry("a.srt", J.CueIds(ids), "1")]).splitlines(keepends=True)
    assert J.load_entries(lines, [], 1)[0].cue_ids == list(ids) and J.load_entries(lines, [], 1, named=False)[0].cue_ids == []


def test_a_long_file_holds_up_no_others(made):
    root, plan = made
    helpers = C.Helpers(2, os.open(root, os.O_RDONLY))
    done = []

    def work(n):
        while n == 0 and len(done) < 19 and time.time() < late:
            time.sleep(0.01)
        done.append(n)
        return n

    late, helpers._one = time.time() + 5, work
    try:
        first = next(helpers.run(((n,) for n in range(20)), lambda: False))
    finally:
        helpers.close()
    assert first == 0 and done[-1] == 0 and len(done) == 20
