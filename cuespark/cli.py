"""Commands: scan, search, remove, undo, recovery. ``python -m cuespark COMMAND ...``"""

from __future__ import annotations

import argparse
import itertools
import os
import sys
from collections.abc import Callable
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cuespark import __version__
from cuespark import output as O
from cuespark.kernel.formats import detect_format
from cuespark.kernel.texts import normalize_search
from cuespark.operators.discovery import by_folded_path
from cuespark.session import Session
from cuespark.workspace import Summary, Workspace, WorkspaceError


class Usage(Exception):
    """A wrong command line; exit code 2."""


class _Parser(argparse.ArgumentParser):
    def __init__(self, *args, **named):
        super().__init__(*args, **{"allow_abbrev": False} | named)

    def error(self, message: str):
        raise Usage(message)


class _Once(argparse.Action):
    def __call__(self, parser, namespace, value, option=None):
        if getattr(namespace, "target", None) is not None:
            raise Usage("exactly one -d/--directory or -f/--file must be provided")
        if not value:
            raise Usage(f"{option} requires a nonempty path")
        namespace.target = (self.const, value)


def _phrase(text: str) -> str:
    if not normalize_search(text):
        raise Usage("phrases must not normalize to empty")
    return text


def build_parser() -> argparse.ArgumentParser:
    common = _Parser(add_help=False)
    common.add_argument("-d", "--directory", action=_Once, const="directory", metavar="DIRECTORY")
    common.add_argument("-f", "--file", action=_Once, const="file", metavar="FILE")
    shown = common.add_mutually_exclusive_group()
    shown.add_argument("--json", action="store_true", help="print one JSON document")
    shown.add_argument("-q", "--quiet", action="store_true", help="print nothing; the exit code tells")

    parser = _Parser(prog="cuespark", description="Search and remove cues of SRT, ASS and WebVTT files.")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True, parser_class=_Parser)
    commands.add_parser("version", help="print the version")
    commands.add_parser("help", help="print this text, or that of a command").add_argument("topic", nargs="*", metavar="COMMAND")
    commands.add_parser("scan", parents=[common], help="list files and issues")
    for name, text in (("search", "list cues that hold any phrase"), ("remove", "remove those cues")):
        sub = commands.add_parser(name, parents=[common], help=text)
        if name == "remove":
            sub.add_argument("--dry-run", action="store_true", help="show what would be removed")
        sub.add_argument("phrases", nargs="+", type=_phrase, metavar="PHRASE")
    commands.add_parser("undo", parents=[common], help="restore the undo point")
    recovery = commands.add_parser("recovery", help="interrupted changes").add_subparsers(dest="action", required=True, parser_class=_Parser)
    recovery.add_parser("list", parents=[common])
    for name in ("restore", "discard"):
        recovery.add_parser(name, parents=[common]).add_argument("id", metavar="ID")
    return parser


def resolve_target(kind: str, value: str) -> O.Target:
    """The directory, or the file with its directory; the file itself may be missing."""
    if kind == "directory":
        if not os.path.isdir(value):
            raise Usage(f"{value} is no directory")
        return O.Target(os.path.realpath(value))
    parent, name = os.path.split(value)
    if not os.path.isdir(parent or "."):
        raise Usage(f"the directory of {value} doesn't exist")
    if not name or not detect_format(name):
        raise Usage(f"unsupported subtitle format: {value}")
    return O.Target(os.path.realpath(parent or "."), name)


class Runner:
    """Carries out one parsed command."""

    def __init__(self, spark: Callable[[], SparkSession], asked: argparse.Namespace, out: TextIO, err: TextIO):
        self.spark, self.asked, self.out, self.err = spark, asked, out, err
        self.target = resolve_target(*asked.target)
        self.workspace = Workspace(self.target.root)

    def show(self, document: dict, lines: tuple[O.Lines, O.Lines]) -> None:
        if self.asked.json:
            O.write_json(self.out, document)
        elif not self.asked.quiet:
            shown = O.coloured if self.out.isatty() and not os.environ.get("NO_COLOR") else str
            for stream, own in ((self.out, lines[0]), (self.err, lines[1])):
                for line in own:
                    stream.write((shown(line) if stream is self.out else line) + "\n")

    def scan(self) -> int:
        found = Session(self.spark(), self.workspace).discover(self.target.file)
        files, issues = self._files(found), self._issues(found)
        summary = {"files": found.files.count(), "issues": found.issues.count()}
        code = O.result_code(summary["files"], summary["issues"])
        self.show(O.envelope("scan", self.target, code, files=files, issues=issues, summary=summary), O.scan_lines(files, issues, summary))
        return code

    def _files(self, found) -> O.Rows:
        rows = by_folded_path(found.files.select("path", "format", "encoding", F.col("cue_count").alias("cues"), "size"))
        return O.Rows(lambda: (r.asDict() for r in rows.toLocalIterator()))

    def _issues(self, found) -> O.Rows:
        rows = by_folded_path(found.issues.select("path", "kind", "error"))
        return O.Rows(lambda: ({k: v for k, v in r.asDict().items() if v is not None} for r in rows.toLocalIterator()))

    def search(self, command: str = "search", dry_run: bool = False) -> int:
        session = Session(self.spark(), self.workspace)
        found = session.discover(self.target.file)
        review = session.search(self.asked.phrases)
        issues, skipped = self._issues(found), found.issues.count()
        if command == "remove" and not dry_run and not review.matches.isEmpty():
            plan = session.plan(review)
            with self.workspace.interruptible():
                summary = session.remove(plan)
            code = O.mutation_code(summary, bool(skipped or summary.error))
            self._mutation("remove", summary, code, issues, list(review.phrases))
            return code
        rows = review.matches.select("path", F.col("cue_id").alias("id"), "start_ms", "end_ms", F.col("display_text").alias("text"), "matched_phrases", "ordinal").orderBy("path", "ordinal")
        matches = O.Rows(lambda: ({k: v for k, v in r.asDict().items() if k != "ordinal"} for r in rows.toLocalIterator()))
        totals = review.matches.agg(F.count(F.lit(1)).alias("cues"), F.count_distinct("path").alias("files")).first()
        counts = {"matching_cues": totals.cues, "matching_files": totals.files, "scanned_files": found.files.count(), "skipped_files": skipped}
        code = O.result_code(totals.cues, skipped)
        parts = {"dry_run": dry_run, "queries": list(review.phrases), "summary": counts, "matches": matches, "issues": issues}
        self.show(O.envelope(command, self.target, code, **parts), O.search_lines(matches, issues, counts, dry_run))
        return code

    def remove(self) -> int:
        return self.search("remove", self.asked.dry_run)

    def undo(self) -> int:
        try:
            with self.workspace.interruptible():
                summary = self.workspace.undo(allowed=self.target.allowed)
        except WorkspaceError as e:
            if e.code != "no-undo":
                raise
            self.show(O.envelope("undo", self.target, O.EMPTY, error=str(e)), ((), (str(e),)))
            return O.EMPTY
        code = O.mutation_code(summary, bool(summary.error))
        self._mutation("undo", summary, code)
        return code

    def _mutation(self, action: str, summary: Summary, code: int, issues: O.Rows | None = None, queries: list[str] | None = None) -> None:
        parts = O.mutation_parts(summary) | {"issues": issues, "queries": queries, "error": summary.error}
        lines = O.mutation_lines(action, summary)
        more = O.follow_up(self.target, summary, action == "remove")
        self.show(O.envelope(action, self.target, code, **parts), ([*lines[0], *more[0]], itertools.chain(O.issue_lines(issues or ()), lines[1], more[1])))

    def recovery(self) -> int:
        action = self.asked.action
        if action == "list":
            items = [i for i in self.workspace.recoveries() if self.target.file is None or list(i.file_paths) == [self.target.file]]
            document = O.envelope("recovery list", self.target, O.OK, summary={"recoveries": len(items)}, recoveries=O.recovery_parts(items))
            self.show(document, O.recovery_lines(items))
            return O.OK
        if action == "discard":
            self.workspace.discard_recovery(self.asked.id, self.target.allowed)
            self.show(O.envelope("recovery discard", self.target, O.OK, summary={"succeeded": 1}), ((f"DISCARDED id={O.sanitize(self.asked.id)}",), ()))
            return O.OK
        with self.workspace.interruptible():
            summary = self.workspace.restore_recovery(self.asked.id, self.target.allowed)
        code = O.mutation_code(summary, bool(summary.error))
        self._mutation("recovery restore", summary, code)
        return code


def run(args: list[str], spark: Callable[[], SparkSession], out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> int:
    """Runs one command line and gives its exit code. ``spark`` is only asked for a session if one is needed."""
    try:
        asked = build_parser().parse_args(args)
        if asked.command == "help":
            build_parser().parse_args([*asked.topic, "--help"])
        if asked.command == "version":
            out.write(f"{__version__}\n")
            return O.OK
        if getattr(asked, "target", None) is None:
            raise Usage("exactly one -d/--directory or -f/--file is required")
        runner = Runner(spark, asked, out, err)
    except Usage as e:
        err.write(f"cuespark: {O.sanitize(str(e))}\n")
        return O.USAGE
    except SystemExit as e:  # help and version
        return int(e.code or 0)
    command = asked.command + (f" {asked.action}" if asked.command == "recovery" else "")
    try:
        return getattr(runner, asked.command)()
    except KeyboardInterrupt:
        # nothing is under way here: changes end by themselves after an interrupt
        if asked.json:
            out.write(O.to_json(O.envelope(command, runner.target, O.INTERRUPTED, error="interrupted")))
        elif not asked.quiet:
            err.write("cuespark: interrupted\n")
        return O.INTERRUPTED
    except (WorkspaceError, OSError) as e:
        if asked.json:
            out.write(O.to_json(O.envelope(command, runner.target, O.FAILED, error=str(e))))
        elif not asked.quiet:
            err.write(f"cuespark: {O.sanitize(str(e))}\n")
        return O.FAILED


def main() -> int:
    return run(sys.argv[1:], lambda: SparkSession.builder.appName("cuespark").getOrCreate())
