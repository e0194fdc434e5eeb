"""One file of a transaction, changed or put back: in the workspace's process, or in helpers beside it."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import os
import pickle
import queue
import signal
import subprocess
import sys
import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor, wait
from typing import BinaryIO

from cuespark.kernel import files as K
from cuespark.kernel import journal as J
from cuespark.kernel.formats import detect_format, parse
from cuespark.kernel.rewrite import delete_cues, validate_deletion
from cuespark.kernel.source import Malformed

Outcome = tuple[str, int, list[str], str]  # status, deleted cues, warnings, error
LARGE = 1 << 20  # bytes of a file from which only one is worked on at a time
AHEAD = 4_096  # files that may be done before one that takes long


def read_record(at: str, most: int) -> bytes:
    file = os.open(at, os.O_RDONLY | os.O_NOFOLLOW)
    with os.fdopen(file, "rb") as f:
        if os.fstat(f.fileno()).st_mode & 0o077:
            raise J.BadRecord("record is open to others")
        return f.read(most + 1)


def save_state(at: str, n: int, entry: J.Entry) -> None:
    """One line more in the log of states, flushed; what is saved for a file doesn't depend on the others."""
    file = os.open(os.path.join(at, "states.jsonl"), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600)
    with os.fdopen(file, "r+b") as f:
        fcntl.flock(f.fileno(), fcntl.LOCK_EX)  # lines of helpers don't mix
        end = f.seek(0, os.SEEK_END)
        if end and (f.seek(end - 1), f.read(1))[1] != b"\n":  # a line cut short by a crash is overwritten
            end = _last_line(f, end)
        f.seek(end)
        f.write(J.state_line(n, entry))
        f.truncate()
        f.flush()
        fcntl.flock(f.fileno(), fcntl.LOCK_UN)
        os.fsync(f.fileno())


def _last_line(f: BinaryIO, end: int) -> int:
    begin = max(0, end - J.MOST_LINE)
    f.seek(begin)
    return begin + f.read(end - begin).rfind(b"\n") + 1


def change_file(root: str, at: str, n: int, entry: J.Entry, identity: tuple[str, int, int] | None) -> Outcome:
    """Deletes the cues of ``entry``, file ``n`` of the transaction in the folder ``at``."""

    def end(status: str, state: str, error: str = "") -> Outcome:
        entry.state, entry.error = state, error
        save_state(at, n, entry)
        return status, 0, [], error

    cue_ids = list(entry.cue_ids)
    try:
        old = K.read_safe(root, entry.path, entry.original_sha256, identity)
    except K.FileProblem as e:
        if e.kind == "conflict":
            return end("conflicted", "conflict", e.message)
        return end("skipped" if e.kind == "unsafe" else "failed", "failed", e.message)
    except OSError as e:
        return end("failed", "failed", str(e))
    try:
        document = parse(old.data, detect_format(entry.path))
        new = delete_cues(old.data, document, cue_ids)
    except Malformed as e:
        return end("failed", "failed", e.message)
    if new == old.data:
        return end("skipped", "failed", "deletion rendered no change")
    fault = validate_deletion(old.data, document, cue_ids, new)
    if fault:
        return end("failed", "failed", fault)
    entry.mode, entry.mtime_ns, entry.uid, entry.gid = old.mode, old.mtime_ns, old.uid, old.gid
    entry.post_sha256, entry.backup = hashlib.sha256(new).hexdigest(), f"{n:06d}.bin"
    try:
        K.write_durably(os.path.join(at, "backup"), entry.backup, old.data)
    except OSError as e:
        return end("failed", "failed", f"backup can't be written: {e}")
    # written ahead: until this is saved nothing has changed, from then on the file may have
    end("failed", "prepared")
    try:
        warnings = K.replace_file(root, entry.path, old, new, old.mode, old.mtime_ns, (old.uid, old.gid))
    except K.FileProblem as e:
        return end("conflicted", "conflict", e.message)
    except K.ReplaceFailed as e:
        return end("failed", "prepared" if e.attempted else "failed", str(e))
    end("succeeded", "committed")
    return "succeeded", len(cue_ids), warnings, ""


def restore_file(root: str, at: str, n: int, entry: J.Entry) -> Outcome:
    """One file back to its backup, unless neither version of the transaction is there."""
    if not entry.backup or entry.state in ("planned", "backed-up"):
        return "skipped", 0, [], ""

    def end(status: str, state: str, error: str = "", warnings: list[str] | None = None) -> Outcome:
        entry.state, entry.error = state, error
        save_state(at, n, entry)
        return status, 0, warnings or [], error

    try:
        backup = read_record(os.path.join(at, "backup", entry.backup), K.MOST_BYTES)
    except (OSError, J.BadRecord) as e:
        return end("failed", "failed", f"backup can't be read: {e}")
    if hashlib.sha256(backup).hexdigest() != entry.original_sha256:
        return end("failed", "failed", "backup has another digest than the manifest")
    try:
        now = K.read_safe(root, entry.path)
    except (K.FileProblem, OSError) as e:
        return end("conflicted", "conflict", f"file can't be inspected: {e}")
    if now.sha256 == entry.original_sha256:
        return end("restored", "restored")
    if now.sha256 != entry.post_sha256:
        return end("conflicted", "conflict", "file is in neither version of the transaction")
    try:
        warnings = K.replace_file(root, entry.path, entry.post_sha256, backup, entry.mode, entry.mtime_ns, (entry.uid, entry.gid))
    except K.FileProblem as e:
        return end("conflicted", "conflict", e.message)
    except K.ReplaceFailed as e:
        return end("failed", "prepared" if e.attempted else "failed", str(e))
    return end("restored", "restored", warnings=warnings)


_WORK: dict[str, Callable[..., Outcome]] = {"change": change_file, "restore": restore_file}


def serve() -> None:
    """A helper: takes files from its input until that ends, whatever signals come; what it has begun it finishes."""
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, signal.SIG_IGN)
    tasks, answers = sys.stdin.buffer, sys.stdout.buffer
    while True:
        try:
            work, root, at, n, entry, *more = pickle.load(tasks)
        except EOFError:
            return
        try:
            answer = _WORK[work](root, at, n, entry, *more), [getattr(entry, f) for f in J.STATE_FIELDS]
        except Exception as e:  # told to the workspace, which ends with it
            answer = e, []
        try:
            pickle.dump(answer, answers)
            answers.flush()
        except BrokenPipeError:
            return


class Helpers:
    """Processes that work on the files of one transaction at once, each file by the same steps as alone.

    They keep the handle ``lock`` open, so that the workspace stays locked while one of them is at work.
    """

    def __init__(self, count: int, lock: int):
        self.lock, self.closed = lock, False
        self.idle: queue.SimpleQueue[subprocess.Popen] = queue.SimpleQueue()
        self.large = threading.Lock()
        self.threads = ThreadPoolExecutor(count)
        self.count = count
        for _ in range(count):
            self.idle.put(self._start())

    def _start(self) -> subprocess.Popen:
        home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        code = "import sys; sys.path.insert(0, sys.argv[1]); from cuespark.kernel.changes import serve; serve()"
        return subprocess.Popen([sys.executable, "-c", code, home], stdin=subprocess.PIPE, stdout=subprocess.PIPE, pass_fds=(self.lock,))

    @staticmethod
    def _end(process: subprocess.Popen) -> None:
        with contextlib.suppress(OSError):
            process.stdin.close()
        process.wait()
        process.stdout.close()

    def _one(self, work: str, root: str, at: str, n: int, entry: J.Entry, *more: object) -> Outcome:
        try:
            large = os.lstat(os.path.join(root, entry.path)).st_size > LARGE
        except (OSError, ValueError):
            large = False
        with self.large if large else contextlib.nullcontext():
            process = self.idle.get()
            try:
                pickle.dump((work, root, at, n, entry, *more), process.stdin)
                process.stdin.flush()
                try:
                    outcome, state = pickle.load(process.stdout)
                except EOFError:
                    raise OSError(f"a helper process ended while it worked on {entry.path}") from None
                if large:  # its memory goes with it
                    self._end(process)
                    process = self._start()
            finally:
                self.idle.put(process)
        if isinstance(outcome, Exception):
            raise outcome
        for name, value in zip(J.STATE_FIELDS, state):
            setattr(entry, name, value)
        return outcome

    def run(self, tasks: Iterable[tuple], stopped: Callable[[], bool]) -> Iterator[Outcome]:
        """The outcomes in the order of ``tasks``. Once ``stopped``, no task is begun, and those under way still give theirs."""
        under_way: deque[Future] = deque()
        left = iter(tasks)
        while True:
            while len(under_way) < AHEAD and not stopped() and (task := next(left, None)):
                under_way.append(self.threads.submit(self._one, *task))
            while under_way and not stopped() and not under_way[0].done():
                wait([under_way[0]], 0.2)
            while stopped() and under_way and under_way[-1].cancel():  # they begin in order, so what hasn't is the end
                under_way.pop()
            if not under_way:
                return
            yield under_way.popleft().result()

    def close(self) -> None:
        self.threads.shutdown()
        for _ in range(self.count):
            self._end(self.idle.get())
