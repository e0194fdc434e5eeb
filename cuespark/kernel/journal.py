"""The transaction journal: manifests, pointers, and what follows from them.

Everything about which transaction is the undo point, which is pending and which may be thrown away
is decided here by pure functions on values; reading and writing them is the workspace's business.
"""

from __future__ import annotations

import dataclasses
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from cuespark.kernel.files import safe_relative

VERSION = 1
MOST_MANIFEST, MOST_POINTERS = 4 << 20, 1 << 20
MOST_LINE = 4 << 20  # bytes of one line of entries
LINE_IDS = 10_000  # cue ids of one line: the ids of a file with more continue on the next
# The states of a transaction and of its files.
STATUSES = ("active", "complete", "apply-partial", "undoing", "undo-partial", "recovery-partial")
FILE_STATES = ("planned", "backed-up", "prepared", "committed", "restored", "conflict", "failed")
UNDOABLE = ("complete", "undo-partial", "undoing")
_ID = re.compile(r"[a-z0-9-]{1,128}")


class BadRecord(Exception):
    """A journal record that can't be trusted."""


def valid_id(name: str) -> bool:
    return bool(_ID.fullmatch(name)) and name.startswith("tx-")


class CueIds(Sequence):
    """The cue ids of a file, packed: a plan of many files holds millions."""

    __slots__ = ("packed", "count")

    def __init__(self, ids: Iterable[str]):
        ids = list(ids)
        self.packed, self.count = zlib.compress(json.dumps(ids, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1), len(ids)

    def _all(self) -> tuple[str, ...]:
        return tuple(json.loads(zlib.decompress(self.packed).decode("utf-8", "surrogatepass")))

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, at):
        return self._all()[at]

    def __iter__(self) -> Iterator[str]:
        return iter(self._all())

    def __contains__(self, wanted: object) -> bool:
        return wanted in self._all()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, (CueIds, tuple)) and self._all() == tuple(other)

    def __hash__(self) -> int:
        return hash(self._all())

    def __repr__(self) -> str:
        return repr(self._all())


@dataclass
class Entry:
    """One file of a transaction. Digests are hexadecimal."""

    path: str
    cue_ids: Sequence[str]
    original_sha256: str
    post_sha256: str = ""
    mode: int = 0
    mtime_ns: int = 0
    uid: int = 0
    gid: int = 0
    backup: str = ""
    state: str = "planned"
    error: str = ""


@dataclass
class Manifest:
    id: str
    created_at: str
    scope: str
    previous_undo: str = ""
    status: str = "active"
    session: str = ""
    updated_at: str = ""
    files: list[Entry] = field(default_factory=list)
    entries: int = 0  # files that are listed in a file of lines beside the manifest
    version: int = VERSION

    def has(self, *states: str) -> bool:
        return any(f.state in states for f in self.files)

    @property
    def harmless(self) -> bool:
        """Whether no file can have been changed by it."""
        return self.status in ("active", "complete") and not self.has("prepared", "committed")

    @property
    def restorable(self) -> bool:
        """Whether a backup of it could change a file."""
        return any(f.backup and f.state not in ("planned", "backed-up") for f in self.files)

    @property
    def targets(self) -> list[str]:
        return sorted({f.path for f in self.files}, key=lambda p: (p.casefold(), p))


@dataclass(frozen=True)
class Pointers:
    """Which transaction is the undo point and which is pending; garbage is retired and may be deleted."""

    generation: int = 0
    current: str = ""
    pending: str = ""
    garbage: tuple[str, ...] = ()
    version: int = VERSION

    def retire(self, *ids: str, **changes: str) -> Pointers:
        """The pointers with ``changes``, and ``ids`` among the garbage."""
        garbage = tuple(sorted({*self.garbage, *(i for i in ids if i)}))
        return dataclasses.replace(self, garbage=garbage, **changes)

    def role(self, name: str) -> str | None:
        """undo, pending or garbage; null if nothing points to it."""
        roles = {self.current: "undo", self.pending: "pending"} | {g: "garbage" for g in self.garbage}
        return roles.get(name) if name else None


def dump(record: Manifest | Pointers) -> bytes:
    """A record as it is saved; the files of a manifest are saved apart, by ``entry_lines`` and ``state_line``."""
    if isinstance(record, Manifest):
        record = dataclasses.replace(record, files=[], entries=len(record.files))
    return (json.dumps(dataclasses.asdict(record), indent=2, ensure_ascii=False) + "\n").encode()


def _line(record: dict) -> bytes:
    return (json.dumps(record, ensure_ascii=False, separators=(",", ":")) + "\n").encode("utf-8", "surrogatepass")


def each_entry_line(files: list[Entry]) -> Iterator[bytes]:
    """The files of a transaction as they are planned: lines of bounded size, however many files and cues there are."""
    for n, e in enumerate(files):
        ids = list(e.cue_ids)
        for at in range(0, max(1, len(ids)), LINE_IDS):
            yield _line({"n": n, "at": at, "path": e.path, "original_sha256": e.original_sha256, "cue_ids": ids[at : at + LINE_IDS]})


def entry_lines(files: list[Entry]) -> bytes:
    return b"".join(each_entry_line(files))


# what becomes of a file after it was planned
STATE_FIELDS = ("post_sha256", "mode", "mtime_ns", "uid", "gid", "backup", "state", "error")


def state_line(n: int, entry: Entry) -> bytes:
    """One line of the log of states; the last line of a file holds."""
    return _line({"n": n} | {name: getattr(entry, name) for name in STATE_FIELDS})


def load_entries(lines: Iterable[bytes], states: Iterable[bytes], count: int, named: bool = True) -> list[Entry]:
    """The files from their lines and the log of their states. A last line of the log that was cut short never took effect.

    With ``named`` off the cue ids are checked but not kept; only their beginning needs them.
    """
    files: list[dict] = []
    held = 0  # cue ids of the last file so far
    for line in lines:
        raw = _load(line, MOST_LINE)
        if not isinstance(raw, dict) or set(raw) != {"n", "at", "path", "original_sha256", "cue_ids"} or not isinstance(raw["cue_ids"], list):
            raise BadRecord("line of entries has wrong fields")
        n, at, ids = raw.pop("n"), raw.pop("at"), raw["cue_ids"]
        if (n, at) == (len(files), 0):
            files.append(raw | {"cue_ids": []})
            held = 0
        elif not files or (n, at) != (len(files) - 1, held) or raw["path"] != files[-1]["path"]:
            raise BadRecord("lines of entries are out of order")
        held += len(ids)
        if named:
            files[-1]["cue_ids"] += ids
    if len(files) != count:
        raise BadRecord("lines of entries are missing")
    for line in states:
        if not line.endswith(b"\n"):
            break
        raw = _load(line, MOST_LINE)
        if not isinstance(raw, dict) or set(raw) != {"n", *STATE_FIELDS} or not isinstance(raw["n"], int) or not 0 <= raw["n"] < count:
            raise BadRecord("line of states has wrong fields")
        files[raw.pop("n")].update(raw)
    return [Entry(**_strict(Entry, f)) for f in files]


def _strict(kind: type, raw: object) -> dict:
    if not isinstance(raw, dict):
        raise BadRecord("record is no object")
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := set(raw) - set(known):
        raise BadRecord(f"unknown field {sorted(extra)[0]}")
    required = {n for n, f in known.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    if lacking := required - set(raw):
        raise BadRecord(f"field {sorted(lacking)[0]} is missing")
    for name, value in raw.items():
        wanted = {"int": int, "str": str, "Sequence[str]": list, "list[Entry]": list, "tuple[str, ...]": list}[known[name].type]
        if not isinstance(value, wanted) or isinstance(value, bool):
            raise BadRecord(f"field {name} has a wrong type")
    return raw


def _load(data: bytes, most: int) -> object:
    if len(data) > most:
        raise BadRecord("record is too large")
    try:
        return json.loads(data)
    except ValueError as e:
        raise BadRecord(f"record is no JSON: {e}") from None


def load_manifest(data: bytes, name: str, entries: Callable[[int], list[Entry]] | None = None) -> Manifest:
    """A manifest. ``entries`` reads the files that are listed beside it; a manifest may hold its files itself, too."""
    raw = dict(_strict(Manifest, _load(data, MOST_MANIFEST)))
    raw["files"] = [Entry(**_strict(Entry, f)) for f in raw.get("files", [])]
    if raw.get("entries") and entries:
        raw["files"] += entries(raw["entries"])
    made = Manifest(**raw | {"entries": 0})
    if made.version != VERSION or made.id != name or not valid_id(name) or made.status not in STATUSES:
        raise BadRecord("manifest doesn't fit its place")
    for f in made.files:
        if f.state not in FILE_STATES or not safe_relative(f.path) or (f.backup and not re.fullmatch(r"[0-9]{6,}\.bin", f.backup)):
            raise BadRecord("manifest has an unsafe file entry")
    return made


def load_pointers(data: bytes) -> Pointers:
    raw = dict(_strict(Pointers, _load(data, MOST_POINTERS)))
    made = Pointers(**(raw | {"garbage": tuple(raw.get("garbage", ()))}))
    ids = [i for i in (made.current, made.pending, *made.garbage) if i]
    if made.version != VERSION or made.generation < 0 or len(set(ids)) != len(ids) or not all(isinstance(i, str) and valid_id(i) for i in ids):
        raise BadRecord("pointers don't hold distinct transactions")
    return made


def newest(manifests: list[Manifest]) -> str:
    return max(((m.created_at, m.id) for m in manifests), default=("", ""))[1]


def adopt(manifests: dict[str, Manifest | None]) -> Pointers:
    """The pointers for transactions that were left without any: the newest restorable complete one is the undo point."""
    known = [m for m in manifests.values() if m]
    complete = [m for m in known if m.status == "complete"]
    undo = newest([m for m in complete if m.restorable])
    pending = newest([m for m in known if m.status == "active" and not m.harmless])
    retired = [m.id for m in complete if m.id != undo] + [m.id for m in known if m.status == "active" and m.harmless]
    return Pointers(current=undo, pending=pending).retire(*retired)


def settle(pointers: Pointers, manifests: dict[str, Manifest | None]) -> Pointers | None:
    """The next transition that the records prove, or null. ``manifests`` has null for unreadable ones.

    A pending transaction that changed nothing is retired; one that is complete and began from the
    present undo point becomes the undo point. Unreferenced ones that changed nothing are retired.
    Everything else stays, and blocks.
    """
    pending = manifests.get(pointers.pending) if pointers.pending else None
    if pending:
        chained = pending.previous_undo == pointers.current
        if pending.harmless and (pending.status == "active" or chained):
            return pointers.retire(pending.id, pending="")
        if pending.status == "complete" and pending.has("committed") and chained:
            return pointers.retire(pointers.current, current=pending.id, pending="")
    for name in sorted(manifests):
        found = manifests[name]
        if found and found.harmless and pointers.role(name) is None:
            return pointers.retire(name)
    return None


@dataclass(frozen=True)
class Recovery:
    """A stored or referenced transaction, as it is listed."""

    id: str
    role: str
    created_at: str = ""
    status: str = ""
    files: int = 0
    changed: int = 0
    file_paths: tuple[str, ...] = ()
    corrupt: bool = False
    blocks_mutation: bool = True
    error: str = ""


def recoveries(pointers: Pointers, manifests: dict[str, Manifest | None], errors: dict[str, str]) -> list[Recovery]:
    """All transactions, newest first. Pending, orphaned, retired and corrupt ones block changes; an undo point only if partial."""
    names = {*manifests, *(i for i in (pointers.current, pointers.pending, *pointers.garbage) if i)}
    out = []
    for name in names:
        found = manifests.get(name)
        if found is None:
            out.append(Recovery(name, "corrupt", corrupt=True, error=errors.get(name, "transaction is missing")))
            continue
        role = pointers.role(name) or "orphan"
        changed = sum(f.state in ("committed", "prepared", "restored", "conflict") for f in found.files)
        blocks = role != "undo" or found.status != "complete" or not found.restorable
        out.append(Recovery(name, role, found.created_at, found.status, len(found.files), changed, tuple(found.targets), False, blocks))
    return sorted(out, key=lambda r: (r.created_at, r.id), reverse=True)


def after_restore(pointers: Pointers, manifest: Manifest, role: str) -> Pointers:
    """The pointers once a transaction is restored without a fault. Without proof of the order, the undo point goes too."""
    if role == "undo":
        return pointers.retire(manifest.id, current="")
    if role == "pending" and manifest.previous_undo == pointers.current:
        return pointers.retire(manifest.id, pending="")
    pending = "" if role == "pending" else pointers.pending
    return pointers.retire(manifest.id, pointers.current, current="", pending=pending)


def after_discard(pointers: Pointers, name: str) -> Pointers:
    """The pointers once a transaction is given up; retired ones are only forgotten."""
    role = pointers.role(name)
    if role == "garbage":
        return dataclasses.replace(pointers, garbage=tuple(g for g in pointers.garbage if g != name))
    if role == "undo":
        return pointers.retire(name, current="")
    pending = "" if role == "pending" else pointers.pending
    return pointers.retire(name, pointers.current, current="", pending=pending)
