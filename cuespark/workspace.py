"""Changes of files as transactions: apply, undo, recovery. Runs on the driver, one writer at a time.

The journal lives below the root in ``.cuespark-recovery``: per transaction a manifest, the list of its
files, a log of their states and the backups; and the pointers to the undo point and the pending
transaction. What is on disk always
allows to go back: a backup is flushed before its file is replaced, and a pointer moves before
anything is deleted.
"""

from __future__ import annotations

import contextlib
import fcntl
import os
import secrets
import shutil
import signal
import sys
import threading
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from cuespark.kernel import changes as C
from cuespark.kernel import files as K
from cuespark.kernel import journal as J
from cuespark.kernel.formats import detect_format

RECOVERY = ".cuespark-recovery"
HELPERS, HELPED_FROM = 6, 200  # processes at most, and the files of a change from which they are worth their start


class WorkspaceError(Exception):
    """A request that was refused or failed; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class FilePlan:
    path: str
    sha256: str
    identity: tuple[str, int, int] | None
    cue_ids: Sequence[str]


@dataclass(frozen=True)
class Plan:
    """What to delete: pinned to the scan of ``revision`` (0: not checked)."""

    files: tuple[FilePlan, ...]
    scope: str = "all"
    revision: int = 0


def plan_from(frame: DataFrame) -> Plan:
    """A plan from the rows of ``plan_files``: one row per file that is to be changed."""
    files, scope, revision = [], "all", 0
    for r in frame.orderBy("path").toLocalIterator():
        identity = None if r.expected_identity is None else (r.expected_identity.kind, int(r.expected_identity.volume), int(r.expected_identity.object))
        files.append(FilePlan(r.path, r.expected_sha256, identity, J.CueIds(r.cue_ids)))
        scope, revision = r.scope, r.search_revision
    return Plan(tuple(files), scope, revision)


@dataclass
class FileResult:
    path: str
    status: str
    deleted_cues: int = 0
    warnings: list[str] = field(default_factory=list)
    error: str = ""


@dataclass
class Summary:
    """The outcome of a change: results per file, and where the undo point stands."""

    transaction_id: str = ""
    results: list[FileResult] = field(default_factory=list)
    cancelled: bool = False
    undo_id: str = ""
    blocking_recovery_id: str = ""
    recovery_retained: bool = False
    error: str = ""

    def count(self, status: str) -> int:
        return sum(r.status == status for r in self.results)

    @property
    def deleted_cues(self) -> int:
        return sum(r.deleted_cues for r in self.results)

    @property
    def clean(self) -> bool:
        return not (self.cancelled or self.count("conflicted") or self.count("failed"))


@dataclass(frozen=True)
class UndoPoint:
    id: str
    created_at: str
    file_paths: tuple[str, ...]
    partial: bool


@dataclass(frozen=True)
class RecoveryState:
    generation: int
    undo: UndoPoint | None
    items: tuple[J.Recovery, ...]

    @property
    def blocked(self) -> bool:
        return any(i.blocks_mutation for i in self.items)


Progress = Callable[[int, int, FileResult], None]


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


class Workspace:
    """A root directory whose files may be changed."""

    def __init__(self, root: str):
        self.path = os.path.realpath(root)
        if not os.path.isdir(self.path):
            raise WorkspaceError("not-a-directory", f"{root} is no directory")
        self.revision = 0
        self.closed = False
        self.cancel = False
        self.session = secrets.token_hex(8)

    # journal on disk

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, RECOVERY, *parts)

    def _ensure(self) -> None:
        with contextlib.suppress(FileExistsError):
            os.mkdir(self._at(), 0o700)
        if os.path.islink(self._at()) or not os.path.isdir(self._at()):
            raise WorkspaceError("unsafe", "the recovery folder is no plain directory")

    @contextlib.contextmanager
    def _locked(self) -> Iterator[None]:
        """The only writer: other processes and handles are refused, not waited for."""
        if self.closed:
            raise WorkspaceError("closed", "workspace is closed")
        self._ensure()
        handle = os.open(self._at("lock"), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600)
        try:
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise WorkspaceError("locked", "another change of this workspace is under way") from None
            self.lock = handle
            yield
        finally:
            os.close(handle)

    def _read_record(self, *parts: str, most: int) -> bytes:
        return C.read_record(self._at(*parts), most)

    def _lines(self, *parts: str) -> Iterator[bytes]:
        file = os.open(self._at(*parts), os.O_RDONLY | os.O_NOFOLLOW)
        with os.fdopen(file, "rb") as f:
            if os.fstat(f.fileno()).st_mode & 0o077:
                raise J.BadRecord("record is open to others")
            while line := f.readline(J.MOST_LINE + 1):
                yield line

    def _manifests(self) -> tuple[dict[str, J.Manifest | None], dict[str, str]]:
        found: dict[str, J.Manifest | None] = {}
        errors: dict[str, str] = {}
        for name in sorted(os.listdir(self._at())):
            if J.valid_id(name):
                try:
                    entries = lambda count, name=name: J.load_entries(self._lines(name, "files.jsonl"), self._lines(name, "states.jsonl"), count, named=False)
                    found[name] = J.load_manifest(self._read_record(name, "manifest.json", most=J.MOST_MANIFEST), name, entries)
                except (OSError, J.BadRecord, TypeError) as e:
                    found[name], errors[name] = None, str(e)
        return found, errors

    def _save(self, manifest: J.Manifest) -> None:
        """The manifest without its files: a small record, whatever the number of files."""
        manifest.updated_at = _now()
        K.write_durably(self._at(manifest.id), "manifest.json", J.dump(manifest))

    def _list(self, manifest: J.Manifest) -> None:
        """Writes the files of a manifest beside it, unless they are there."""
        if not os.path.exists(self._at(manifest.id, "files.jsonl")):
            states = b"".join(J.state_line(n, e) for n, e in enumerate(manifest.files) if e.state != "planned")
            K.write_durably(self._at(manifest.id), "states.jsonl", states)
            K.write_durably(self._at(manifest.id), "files.jsonl", J.each_entry_line(manifest.files))

    def _pointers(self) -> J.Pointers | None:
        try:
            return J.load_pointers(self._read_record("state.json", most=J.MOST_POINTERS))
        except FileNotFoundError:
            return None
        except (OSError, J.BadRecord) as e:
            raise WorkspaceError("bad-state", f"recovery state can't be read: {e}") from None

    def _publish(self, pointers: J.Pointers) -> J.Pointers:
        pointers = replace(pointers, generation=pointers.generation + 1)
        K.write_durably(self._at(), "state.json", J.dump(pointers))
        return pointers

    def _sweep(self, pointers: J.Pointers) -> J.Pointers:
        """Deletes what is retired, one by one."""
        while pointers.garbage:
            self._remove(pointers.garbage[0])
            pointers = self._publish(replace(pointers, garbage=pointers.garbage[1:]))
        return pointers

    def _remove(self, name: str) -> None:
        at = self._at(name)
        if os.path.islink(at) or os.path.isfile(at):
            os.unlink(at)
        elif os.path.isdir(at):
            shutil.rmtree(at)
        K.sync_directory(self._at())

    def _reconcile(self) -> J.Pointers:
        pointers = self._pointers()
        if pointers is None:
            manifests, _ = self._manifests()
            pointers = J.adopt(manifests)
            if manifests:
                pointers = self._publish(pointers)
        while True:
            pointers = self._sweep(pointers)
            following = J.settle(pointers, self._manifests()[0])
            if following is None:
                return pointers
            pointers = self._publish(following)

    def _view(self, pointers: J.Pointers) -> RecoveryState:
        manifests, errors = self._manifests()
        items = tuple(J.recoveries(pointers, manifests, errors))
        found = manifests.get(pointers.current) if pointers.current else None
        undo = UndoPoint(found.id, found.created_at, tuple(found.targets), found.status != "complete") if found and found.restorable else None
        return RecoveryState(pointers.generation, undo, items)

    # questions

    def state(self) -> RecoveryState:
        with self._locked():
            return self._view(self._reconcile())

    def recoveries(self) -> list[J.Recovery]:
        return list(self.state().items)

    def undo_info(self) -> UndoPoint | None:
        with self._locked():
            pointers = self._reconcile()
            view = self._view(pointers)
        if view.undo is None and pointers.current:
            raise WorkspaceError("bad-state", f"the undo point {pointers.current} can't be restored safely")
        return view.undo

    def cleanup_session(self) -> list[str]:
        """Sweeps what is provably unused; gives a warning for each unreadable transaction, which is kept."""
        return [f"recovery transaction {i.id} is unreadable and was kept: {i.error}" for i in self.state().items if i.corrupt]

    def close(self) -> None:
        self.closed = True

    @contextlib.contextmanager
    def interruptible(self) -> Iterator[None]:
        """While it lasts, a first interrupt lets the file under way be finished and what has begun be concluded; a second one is as usual."""
        if threading.current_thread() is not threading.main_thread():
            yield
            return
        before = {s: signal.getsignal(s) for s in (signal.SIGINT, signal.SIGTERM)}

        def stop(number: int, frame: object) -> None:
            self.cancel = True
            for s, handler in before.items():
                signal.signal(s, handler or signal.SIG_DFL)

        try:
            for s in before:
                signal.signal(s, stop)
            yield
        finally:
            for s, handler in before.items():
                signal.signal(s, handler or signal.SIG_DFL)

    @contextlib.contextmanager
    def _helpers(self, files: int) -> Iterator[C.Helpers | None]:
        """Processes that help with a change of many files, while the workspace is locked; none for few files."""
        count = min(HELPERS, os.cpu_count() or 1)
        if files < HELPED_FROM or count < 2 or not sys.executable:
            yield None
            return
        helpers = C.Helpers(count, self.lock)
        try:
            yield helpers
        finally:
            helpers.close()

    # changes

    def begin(self, plan: Plan) -> Transaction:
        lock = contextlib.ExitStack()
        lock.enter_context(self._locked())
        try:
            pointers = self._reconcile()
            if self._view(pointers).blocked:
                raise WorkspaceError("recovery-pending", "an earlier change must be restored or discarded first")
            self._check(plan)
            manifest = J.Manifest(f"tx-{secrets.token_hex(12)}", _now(), plan.scope, pointers.current, session=self.session)
            manifest.files = [J.Entry(f.path, f.cue_ids, f.sha256) for f in plan.files]
            os.makedirs(self._at(manifest.id, "backup"), 0o700)
            self._list(manifest)
            self._save(manifest)
            K.sync_directory(self._at())
            self._publish(replace(pointers, pending=manifest.id))
            return Transaction(self, plan, manifest, lock)
        except BaseException:
            lock.close()
            raise

    def _check(self, plan: Plan) -> None:
        if not plan.files:
            raise WorkspaceError("empty-plan", "a plan needs at least one file")
        if plan.revision and plan.revision != self.revision:
            raise WorkspaceError("stale-plan", "the plan belongs to another scan")
        seen = set()
        for f in plan.files:
            if not K.safe_relative(f.path):
                raise WorkspaceError("unsafe-path", f"unsafe path {f.path!r}")
            if not detect_format(f.path):
                raise WorkspaceError("unsupported", f"unsupported subtitle format: {f.path}")
            if f.identity is None:
                raise WorkspaceError("no-identity", f"{f.path} has no identity to check")
            if f.path in seen:
                raise WorkspaceError("duplicate-path", f"{f.path} is planned twice")
            seen.add(f.path)

    def apply(self, plan: Plan, progress: Progress | None = None) -> Summary:
        """Begins, changes file after file until cancelled, and finishes."""
        transaction = self.begin(plan)
        with self._helpers(len(plan.files)) as helpers:
            if helpers:
                for result in transaction.apply_all(helpers, lambda: self.cancel):
                    if progress:
                        progress(len(transaction.summary.results), len(plan.files), result)
                transaction.summary.cancelled = self.cancel and not transaction.done
        while not transaction.done and not transaction.summary.cancelled:
            if self.cancel:
                transaction.summary.cancelled = True
                break
            result = transaction.apply_one()
            if progress:
                progress(len(transaction.summary.results), len(plan.files), result)
        return transaction.finish()

    def undo(self, expected: str | None = None, allowed: Iterable[str] | None = None, progress: Progress | None = None) -> Summary:
        with self._locked():
            pointers = self._reconcile()
            if not pointers.current:
                raise WorkspaceError("no-undo", "there is nothing to undo")
            if expected and expected != pointers.current:
                raise WorkspaceError("undo-changed", f"the undo point is {pointers.current}, not {expected}")
            if any(i.blocks_mutation and i.id != pointers.current for i in self._view(pointers).items):
                raise WorkspaceError("recovery-pending", "another change must be restored or discarded first")
            manifest = self._manifest(pointers.current)
            self._scope(manifest, allowed)
            return self._restore(pointers, manifest, "undo", progress)

    def restore_recovery(self, name: str, allowed: Iterable[str] | None = None, progress: Progress | None = None) -> Summary:
        with self._locked():
            pointers = self._known(name)
            role = pointers.role(name) or "orphan"
            if role == "garbage":
                raise WorkspaceError("recovery-pending", f"{name} is retired already")
            manifest = self._manifest(name)
            self._scope(manifest, allowed)
            if role == "orphan" or (role == "pending" and manifest.previous_undo != pointers.current):
                self._scope_of_undo(pointers, name, allowed)
            return self._restore(pointers, manifest, role, progress)

    def discard_recovery(self, name: str, allowed: Iterable[str] | None = None) -> None:
        with self._locked():
            pointers = self._known(name)
            if allowed is not None:
                self._scope(self._manifest(name, "scope"), allowed)
                if pointers.role(name) in (None, "pending"):
                    self._scope_of_undo(pointers, name, allowed)
            retired = pointers.role(name) == "garbage"
            pointers = self._publish(J.after_discard(pointers, name))
            if retired:
                self._remove(name)
            self._sweep(pointers)

    def _known(self, name: str) -> J.Pointers:
        if not J.valid_id(name):
            raise WorkspaceError("unsafe-path", f"{name!r} is no transaction")
        pointers = self._reconcile()
        if pointers.role(name) is None and name not in self._manifests()[0]:
            raise WorkspaceError("missing", f"there is no transaction {name}")
        return pointers

    def _manifest(self, name: str, code: str = "bad-state") -> J.Manifest:
        manifests, errors = self._manifests()
        if manifests.get(name) is None:
            raise WorkspaceError(code, f"transaction {name} can't be read: {errors.get(name, 'missing')}")
        return manifests[name]

    def _scope(self, manifest: J.Manifest, allowed: Iterable[str] | None) -> None:
        outside = [] if allowed is None else sorted(set(manifest.targets) - set(allowed))
        if outside:
            raise WorkspaceError("scope", f"the transaction also contains {outside[0]}")

    def _scope_of_undo(self, pointers: J.Pointers, name: str, allowed: Iterable[str] | None) -> None:
        if allowed is not None and pointers.current and pointers.current != name:
            self._scope(self._manifest(pointers.current, "scope"), allowed)

    def _restore(self, pointers: J.Pointers, manifest: J.Manifest, role: str, progress: Progress | None) -> Summary:
        if role == "undo" and manifest.status not in J.UNDOABLE:
            raise WorkspaceError("bad-state", f"the undo point has status {manifest.status}")
        manifest.status = "undoing" if role == "undo" else "recovery-partial"
        self._list(manifest)
        self._save(manifest)
        summary, at, total = Summary(manifest.id), self._at(manifest.id), len(manifest.files)
        with self._helpers(total) as helpers:
            if helpers:
                outcomes = helpers.run((("restore", self.path, at, n, e) for n, e in enumerate(manifest.files)), lambda: self.cancel)
            else:
                outcomes = (C.restore_file(self.path, at, n, e) for n, e in enumerate(manifest.files) if not self.cancel)
            for entry, outcome in zip(manifest.files, outcomes):
                result = FileResult(entry.path, *outcome)
                summary.results.append(result)
                if progress:
                    progress(len(summary.results), total, result)
        if len(summary.results) < total:
            summary.cancelled = True
            summary.results += [FileResult(e.path, "not-attempted") for e in manifest.files[len(summary.results) :]]
        if summary.clean:
            pointers = self._sweep(self._publish(J.after_restore(pointers, manifest, role)))
        else:
            manifest.status = "undo-partial" if role == "undo" else "recovery-partial"
            self._save(manifest)
            summary.recovery_retained = True
        return self._annotate(summary, pointers)

    def _annotate(self, summary: Summary, pointers: J.Pointers) -> Summary:
        summary.undo_id, summary.blocking_recovery_id = pointers.current, pointers.pending
        summary.recovery_retained |= bool(pointers.pending or pointers.garbage)
        return summary


class Transaction:
    """A begun change; holds the lock until it is finished. One that is never finished is found by the next reconcile."""

    def __init__(self, workspace: Workspace, plan: Plan, manifest: J.Manifest, lock: contextlib.ExitStack):
        self.workspace, self.plan, self.manifest, self.lock = workspace, plan, manifest, lock
        self.summary = Summary(manifest.id)
        self.finished = False

    @property
    def done(self) -> bool:
        return len(self.summary.results) == len(self.plan.files)

    def apply_one(self) -> FileResult:
        if self.finished or self.done:
            raise WorkspaceError("closed", "the transaction has no file left")
        n = len(self.summary.results)
        space, asked = self.workspace, self.plan.files[n]
        result = FileResult(asked.path, *C.change_file(space.path, space._at(self.manifest.id), n, self.manifest.files[n], asked.identity))
        self.summary.results.append(result)
        return result

    def apply_all(self, helpers: C.Helpers, stopped: Callable[[], bool]) -> Iterator[FileResult]:
        """The rest of the files, several at once; results come in the order of the plan."""
        space, begun = self.workspace, len(self.summary.results)
        files = zip(range(begun, len(self.plan.files)), self.plan.files[begun:], self.manifest.files[begun:])
        for outcome in helpers.run((("change", space.path, space._at(self.manifest.id), n, entry, asked.identity) for n, asked, entry in files), stopped):
            result = FileResult(self.plan.files[len(self.summary.results)].path, *outcome)
            self.summary.results.append(result)
            yield result

    def finish(self) -> Summary:
        """Marks what is left as not attempted and moves the pointers: to this one, if a file was changed."""
        if self.finished:
            raise WorkspaceError("closed", "the transaction is finished")
        self.finished = True
        space, manifest, summary = self.workspace, self.manifest, self.summary
        try:
            left = self.plan.files[len(summary.results) :]
            summary.results += [FileResult(f.path, "not-attempted") for f in left]
            unsure = manifest.has("prepared")
            manifest.status = "apply-partial" if unsure else "complete"
            space._save(manifest)
            pointers = space._pointers()
            if pointers is None or pointers.pending != manifest.id or pointers.current != manifest.previous_undo:
                summary.error = "the pointers changed during the transaction"
            elif unsure:
                summary.error = "a replacement ended in doubt; restore or discard the transaction"
            else:
                following = pointers.retire(manifest.id, pending="")
                if summary.count("succeeded"):
                    following = pointers.retire(pointers.current, current=manifest.id, pending="")
                pointers = space._sweep(space._publish(following))
            summary.recovery_retained = bool(summary.error)
            return space._annotate(summary, pointers or J.Pointers())
        finally:
            self.lock.close()

    def abandon(self) -> None:
        """Lets the lock go without finishing, as a crash would."""
        self.finished = True
        self.lock.close()
