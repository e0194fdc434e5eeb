"""Results as JSON documents and as lines for people."""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TextIO

from cuespark.kernel.formats import format_clock
from cuespark.kernel.journal import Recovery
from cuespark.workspace import Summary

SCHEMA_VERSION = 1
OK, EMPTY, USAGE, FAILED, PARTIAL, INTERRUPTED = 0, 1, 2, 3, 4, 130
STATUS = {OK: "ok", EMPTY: "empty", PARTIAL: "partial", INTERRUPTED: "interrupted"}
# What may act on a terminal or on the direction of text.
_CONTROL = r"\x7f-\x9f\u061c\u200e\u200f\u2028-\u202e\u2066-\u206f"
_SHOWN = re.compile(rf"[\x00-\x1f{_CONTROL}]")
_IN_JSON = re.compile(f"[{_CONTROL}]")
_QUIET_STATUSES = ("skipped", "conflicted", "failed", "not-attempted")


@dataclass(frozen=True)
class Target:
    """What a command works on: a directory, or one file in it."""

    root: str
    file: str | None = None

    @property
    def path(self) -> str:
        return self.root if self.file is None else os.path.join(self.root, self.file)

    @property
    def allowed(self) -> list[str] | None:
        return None if self.file is None else [self.file]


def sanitize(text: str) -> str:
    return _SHOWN.sub("�", text)


def shell_quote(text: str) -> str:
    return "'" + text.replace("'", "'\\''") + "'"


_LEADING = re.compile(r"^[A-Z][A-Z-]*(?= )", re.MULTILINE)
_RED = ("ISSUE", "FAILED", "CONFLICTED", "SKIPPED", "ERROR", "NOT-ATTEMPTED")


def coloured(line: str) -> str:
    """A line for a terminal: the word that it begins with in colour, faults in red."""
    return _LEADING.sub(lambda m: f"\x1b[{31 if m.group() in _RED else 32}m{m.group()}\x1b[0m", line)


def to_json(document: object) -> str:
    """One line of JSON without raw controls or direction marks; keys in the order they were put."""
    text = json.dumps(document, ensure_ascii=False, separators=(",", ":"))
    return _IN_JSON.sub(lambda m: f"\\u{ord(m.group()):04x}", text) + "\n"


class Rows:
    """Records that are written one by one: what makes them is asked anew for every pass."""

    def __init__(self, make: Callable[[], Iterable[dict]]):
        self.make = make

    def __iter__(self) -> Iterator[dict]:
        return iter(self.make())


def write_json(out: TextIO, document: dict) -> None:
    """``to_json`` of a document, piece by piece where it holds ``Rows``."""
    parts = [(k, v) for k, v in document.items()]
    for i, (key, value) in enumerate(parts):
        out.write(("{" if i == 0 else ",") + to_json(key)[:-1] + ":")
        if not isinstance(value, Rows):
            out.write(to_json(value)[:-1])
            continue
        out.write("[")
        for n, row in enumerate(value):
            out.write("," * (n > 0) + to_json(row)[:-1])
        out.write("]")
    out.write("}\n")


_BLANKS = " \t\r\n"


class _Text:
    """A text that is read piece by piece and looked at from ``at`` on."""

    def __init__(self, source: TextIO, piece: int):
        self.source, self.piece, self.text, self.at, self.ended = source, piece, "", 0, False

    def more(self) -> None:
        if self.ended:
            raise ValueError("the document ends too early")
        got = self.source.read(max(self.piece, len(self.text) - self.at))  # a long value is looked at again only as often as it doubles
        self.text, self.at, self.ended = self.text[self.at :] + got, 0, not got

    def peek(self) -> str:
        while True:
            while self.at < len(self.text) and self.text[self.at] in _BLANKS:
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            self.more()

    def take(self, *allowed: str) -> str:
        if (got := self.peek()) not in allowed:
            raise ValueError(f"{got!r} in place of {' or '.join(allowed)}")
        self.at += 1
        return got

    def value(self) -> tuple[object, str]:
        """The next value, and how it is written."""
        self.peek()
        while True:
            try:
                value, end = _DECODER.raw_decode(self.text, self.at)
            except ValueError:
                if self.ended:
                    raise
            else:
                if end < len(self.text) or self.ended:  # else a number might go on
                    written, self.at = self.text[self.at : end], end
                    return value, written
            self.more()


_DECODER = json.JSONDecoder()


def read_json(source: TextIO, key: str, record: Callable[[str], object], piece: int = 1 << 20) -> dict:
    """A document that ``write_json`` wrote, without the array under ``key``, whose values are told one by one, as they are written."""
    text, document, found = _Text(source, piece), {}, False
    text.take("{")
    while True:
        name, _ = text.value()
        text.take(":")
        if name != key:
            document[name], _ = text.value()
        else:
            found = True
            text.take("[")
            if text.peek() == "]":
                text.take("]")
            else:
                while True:
                    record(text.value()[1])
                    if text.take(",", "]") == "]":
                        break
        if text.take(",", "}") == "}":
            break
    if not found:
        raise KeyError(key)
    return document


def envelope(command: str, target: Target, code: int = OK, **parts: object) -> dict:
    """The common frame of all documents; parts that are null don't apply and are left out."""
    head = {
        "schema_version": SCHEMA_VERSION,
        "command": command,
        "status": STATUS.get(code, "error"),
        "root": target.root,
        "target": {"kind": "directory" if target.file is None else "file", "path": target.path},
    }
    order = ("dry_run", "queries", "summary", "files", "matches", "issues", "results", "undo", "recoveries", "error")
    return head | {k: parts[k] for k in order if parts.get(k) is not None and parts.get(k) is not False and parts.get(k) != ""}


def result_code(matches: int, issues: int) -> int:
    return PARTIAL if issues else OK if matches else EMPTY


def mutation_code(summary: Summary, fault: bool) -> int:
    if summary.cancelled:
        return INTERRUPTED
    return PARTIAL if fault or summary.blocking_recovery_id or any(summary.count(s) for s in _QUIET_STATUSES) else OK


def _without_empty(record: dict, *optional: str) -> dict:
    return {k: v for k, v in record.items() if k not in optional or v}


def mutation_parts(summary: Summary) -> dict:
    """``summary``, ``results`` and ``undo`` of a change."""
    counts = {s.replace("-", "_"): summary.count(s) for s in ("succeeded", "restored", "skipped", "conflicted", "failed", "not-attempted")}
    head = _without_empty({"transaction_id": summary.transaction_id, "blocking_recovery_id": summary.blocking_recovery_id}, "transaction_id", "blocking_recovery_id")
    results = [
        _without_empty({"path": r.path, "status": r.status, "deleted_cues": r.deleted_cues, "warnings": r.warnings, "error": r.error}, "warnings", "error")
        for r in summary.results
    ]
    return {
        "summary": head | counts | {"deleted_cues": summary.deleted_cues, "cancelled": summary.cancelled},
        "results": results,
        "undo": {"id": summary.undo_id, "available": bool(summary.undo_id), "recovery_retained": summary.recovery_retained},
    }


def recovery_parts(items: list[Recovery]) -> list[dict]:
    return [
        _without_empty(
            {
                "id": i.id, "role": i.role, "created_at": i.created_at, "status": i.status, "files": i.files, "changed": i.changed,
                "file_paths": sorted(i.file_paths), "corrupt": i.corrupt, "blocks_mutation": i.blocks_mutation, "error": i.error,
            },
            "created_at",
            "error",
        )
        for i in items
    ]


# lines for people: (lines for standard output, lines for standard error)


Lines = Iterable[str]


def _pair(out: list[str], err: list[str]) -> tuple[Lines, Lines]:
    return out, err


def issue_lines(issues: Iterable[dict]) -> Lines:
    return (f"ISSUE {sanitize(i['path'])}  {sanitize(i['kind'] + (': ' + i['error'] if i.get('error') else ''))}" for i in issues)


def scan_lines(files: Iterable[dict], issues: Iterable[dict], summary: dict) -> tuple[Lines, Lines]:
    shown = (f"FILE {sanitize(f['path'])}  format={f['format']} encoding={f['encoding']} cues={f['cues']} size={f['size']}" for f in files)
    return itertools.chain(shown, [f"SUMMARY files={summary['files']} issues={summary['issues']}"]), issue_lines(issues)


def search_lines(matches: Iterable[dict], issues: Iterable[dict], summary: dict, dry_run: bool) -> tuple[Lines, Lines]:
    shown = (
        f"MATCH {sanitize(m['path'])}  {format_clock(m['start_ms'])} --> {format_clock(m['end_ms'])}  {sanitize(m['text'])}  phrases={','.join(map(sanitize, m['matched_phrases']))}"
        for m in matches
    )
    last = f"{'DRY-RUN' if dry_run else 'SUMMARY'} cues={summary['matching_cues']} files={summary['matching_files']} scanned={summary['scanned_files']} issues={summary['skipped_files']}"
    return itertools.chain(shown, [last]), issue_lines(issues)


def mutation_lines(action: str, summary: Summary) -> tuple[Lines, Lines]:
    out, err = [], []
    for r in summary.results:
        line = f"{r.status.upper()} {sanitize(r.path)}" + (f"  deleted={r.deleted_cues}" if r.deleted_cues else "") + (f"  error={sanitize(r.error)}" if r.error else "")
        (err if r.status in _QUIET_STATUSES else out).append(line)
        err += [f"WARNING {sanitize(r.path)}  {sanitize(w)}" for w in r.warnings]
    counts = " ".join(f"{s.replace('-', '_')}={summary.count(s)}" for s in ("succeeded", "restored", "skipped", "conflicted", "failed", "not-attempted"))
    tail = f" undo_id={summary.undo_id}" if summary.undo_id else ""
    tail += f" blocking_recovery_id={summary.blocking_recovery_id}" if summary.blocking_recovery_id else ""
    flag = lambda x: "true" if x else "false"
    out.append(
        f"SUMMARY action={action} {counts} deleted={summary.deleted_cues} cancelled={flag(summary.cancelled)}{tail}"
        f" undo_available={flag(summary.undo_id)} recovery_retained={flag(summary.recovery_retained)}"
    )
    if summary.error:
        err.append(f"error: {sanitize(summary.error)}")
    return _pair(out, err)


def follow_up(target: Target, summary: Summary, removed: bool) -> tuple[Lines, Lines]:
    """The commands that undo a change or resolve what blocks."""
    at = f"{'--directory' if target.file is None else '--file'} {shell_quote(target.path)}"
    out, err = [], []
    if removed and summary.undo_id and summary.count("succeeded"):
        out.append(f"UNDO cuespark undo {at}")
    if summary.blocking_recovery_id:
        name = shell_quote(summary.blocking_recovery_id)
        out.append(f"RECOVERY cuespark recovery restore {at} {name}")
        err.append(f"WARNING {summary.blocking_recovery_id} blocks further changes; restore it, or give up its backups: cuespark recovery discard {at} {name}")
    return _pair(out, err)


def recovery_lines(items: list[Recovery]) -> tuple[Lines, Lines]:
    out = []
    for i in items:
        out.append(
            f"RECOVERY {i.id}  role={i.role} status={i.status} created={i.created_at or 'unknown'} files={i.files} changed={i.changed} blocks={'true' if i.blocks_mutation else 'false'}"
            + (f" error={sanitize(i.error)}" if i.error else "")
        )
        out += [f"  FILE {sanitize(p)}" for p in sorted(i.file_paths)]
    return _pair([*out, f"SUMMARY recoveries={len(items)}"], [])
