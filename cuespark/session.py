"""Reviewed work: changes are accepted only for matches that were looked at, and open files by single-use tokens."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.operators.discovery import Discovery, discover
from cuespark.operators.plan import plan_faults, plan_files
from cuespark.operators.search import distinct_phrases, editor_filter, search_any
from cuespark.shared import checkpointed
from cuespark.ship import ship
from cuespark.workspace import Plan, Progress, Summary, Workspace, WorkspaceError, plan_from


@dataclass(frozen=True)
class Review:
    """The matches of one search, as they were shown."""

    revision: int
    phrases: tuple[str, ...]
    matches: DataFrame


@dataclass(frozen=True)
class OpenFile:
    """One file as it was opened: its token, and its cues at that moment."""

    token: str
    path: str
    revision: int
    cues: DataFrame


class Session:
    """A workspace with its latest scan, its latest review, and its open file."""

    def __init__(self, spark: SparkSession, workspace: Workspace):
        self.spark, self.workspace = ship(spark), workspace
        self.found: Discovery | None = None
        self.review: Review | None = None
        self.opened: OpenFile | None = None

    def discover(self, file: str | None = None) -> Discovery:
        """A new scan. It makes earlier reviews and open files invalid."""
        self.workspace.revision += 1
        self.review = self.opened = None
        self.found = discover(self.spark, self.workspace.path, self.workspace.revision, file)
        return self.found

    def search(self, phrases: list[str]) -> Review:
        found = self._scan()
        matches = checkpointed(search_any(found.cues, phrases))
        self.review = Review(found.revision, tuple(distinct_phrases(phrases).spellings), matches)
        return self.review

    def _scan(self) -> Discovery:
        if self.found is None:
            raise WorkspaceError("no-scan", "nothing was scanned yet")
        return self.found

    def plan(self, review: Review, selected: DataFrame | None = None, scope: str | None = None) -> Plan:
        """The plan of all matches of the present review, or of the selected files' matches."""
        found = self._scan()
        if self.review is not review or review.revision != found.revision:
            raise WorkspaceError("stale-plan", "the matches belong to another search or scan")
        return plan_from(plan_files(review.matches, found.files, scope or ("all" if selected is None else "selected"), found.revision, selected))

    def check_request(self, request: DataFrame, review: Review) -> None:
        """Refuses a request (``path``, ``cue_ids``) for anything that wasn't reviewed."""
        found = self._scan()
        if self.review is not review or review.revision != found.revision:
            raise WorkspaceError("stale-plan", "the matches belong to another search or scan")
        fault = plan_faults(request, found.files, review.matches).orderBy("path", "fault").first()
        if fault:
            raise WorkspaceError("not-reviewed", f"{fault.path}: {fault.fault}")

    def remove(self, plan: Plan, progress: Progress | None = None) -> Summary:
        return self.workspace.apply(plan, progress)

    # one open file

    def open_editor(self, path: str) -> OpenFile:
        """Opens a scanned file. Its token allows one change, and none after a refresh or another opening."""
        found = self._scan()
        cues = checkpointed(found.cues.where(F.col("path") == path))
        if found.files.where(F.col("path") == path).isEmpty():
            raise WorkspaceError("not-indexed", f"{path} is not indexed")
        self.opened = OpenFile(f"editor-{secrets.token_hex(16)}", path, found.revision, cues)
        return self.opened

    def search_editor(self, token: str, phrase: str) -> DataFrame:
        return editor_filter(self._open(token).cues, phrase)

    def _open(self, token: str) -> OpenFile:
        if not token:
            raise WorkspaceError("no-token", "an open file needs its token")
        if self.opened is None or not secrets.compare_digest(token, self.opened.token) or self.opened.revision != self._scan().revision:
            raise WorkspaceError("stale-token", "the file was changed, closed or scanned again since it was opened")
        return self.opened

    def remove_in_editor(self, token: str, path: str, cue_ids: list[str], progress: Progress | None = None) -> Summary:
        """Deletes cues of the open file. A refused request leaves the token valid; an accepted one uses it up."""
        opened = self._open(token)
        if path != opened.path:
            raise WorkspaceError("wrong-path", f"{path} is not the open file")
        if not cue_ids or len(set(cue_ids)) < len(cue_ids):
            raise WorkspaceError("bad-cues", "cues must be named, each once")
        chosen = opened.cues.where(F.col("cue_id").isin(list(cue_ids)))
        if chosen.count() != len(cue_ids):
            raise WorkspaceError("not-reviewed", "a cue is not in the open file")
        plan = plan_from(plan_files(chosen, self._scan().files, "editor", opened.revision))
        self.opened = None
        return self.workspace.apply(plan, progress)
