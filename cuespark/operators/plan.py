"""Mutation plans from matches, and the proofs that a plan may be carried out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.operators.ranking import number_in, running_totals

SCOPES = ("all", "selected", "focused", "editor")
STATUSES = ("succeeded", "restored", "skipped", "conflicted", "failed", "not-attempted")


def plan_files(matches: DataFrame, files: DataFrame, scope: str, revision: int, selected: DataFrame | None = None) -> DataFrame:
    """One row per file: ``path``, ``expected_sha256``, ``expected_identity``, ``cue_ids`` in source order, revision and scope.

    ``selected`` (``path``) keeps those files only; null means all. A row is as large as its file: the
    bytes of one file (64 MiB at most) have the cues that its list names.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    if selected is not None:
        matches = matches.join(selected.select("path").distinct(), "path", "left_semi")
    named = matches.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "cue_id"))), lambda x: x["cue_id"]).alias("cue_ids"))
    now = files.select("path", F.col("sha256").alias("expected_sha256"), F.col("identity").alias("expected_identity"))
    return named.join(now, "path").select("path", "expected_sha256", "expected_identity", "cue_ids", F.lit(revision).cast("bigint").alias("search_revision"), F.lit(scope).alias("scope"))


def unreviewed(plan: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``path``, ``cue_id`` of a plan that the reviewed matches don't hold; empty for an honest plan."""
    asked = plan.select("path", F.explode("cue_ids").alias("cue_id"))
    return asked.join(reviewed.select("path", "cue_id"), ["path", "cue_id"], "left_anti")


def plan_faults(plan: DataFrame, files: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``path``, ``fault`` of what forbids a plan: repeated target, path not scanned, empty list, repeated cue, cue not reviewed."""
    repeated = plan.groupBy("path").count().where("count > 1").select("path", F.lit("duplicate target").alias("fault"))
    unknown = plan.join(files.select("path"), "path", "left_anti").select("path", F.lit("path is not indexed").alias("fault"))
    empty = plan.where(F.size("cue_ids") == 0).select("path", F.lit("no cues selected").alias("fault"))
    twice = plan.where(F.size(F.array_distinct("cue_ids")) < F.size("cue_ids")).select("path", F.lit("duplicate cue").alias("fault"))
    strange = unreviewed(plan, reviewed).select("path", F.lit("cue outside of the reviewed matches").alias("fault"))
    return repeated.unionByName(unknown).unionByName(empty).unionByName(twice).unionByName(strange).distinct()


def conflicts(plan: DataFrame, current: DataFrame) -> DataFrame:
    """``path``, ``status``: ``conflicted`` where a file is gone or has other bytes or another identity than planned, else ``ready``."""
    now = current.select("path", "sha256", "identity")
    same = (F.col("sha256") == F.col("expected_sha256")) & F.col("identity").eqNullSafe(F.col("expected_identity"))
    return plan.join(now, "path", "left").select("path", F.when(F.coalesce(same, F.lit(False)), "ready").otherwise("conflicted").alias("status"))


def mutation_summary(results: DataFrame) -> DataFrame:
    """One row: files per status and the sum of ``deleted_cues``."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.replace("-", "_"))
    return results.agg(*[count(s) for s in STATUSES], F.coalesce(F.sum("deleted_cues"), F.lit(0)).cast("bigint").alias("deleted_cues"))


def recovery_roles(manifests: DataFrame, pointers: DataFrame) -> DataFrame:
    """``id``, ``role`` of every transaction that is stored or pointed to.

    ``pointers`` has ``id`` and ``role`` (undo, pending, garbage); what none points to is an orphan, and what
    is pointed to but not stored, or stored unreadably (``corrupt``), is corrupt unless it is garbage.
    """
    ids = manifests.select("id").union(pointers.select("id")).distinct()
    held = manifests.select("id", F.coalesce(F.col("corrupt"), F.lit(False)).alias("corrupt"), F.lit(True).alias("held"))
    role = F.when(F.col("role") == "garbage", "garbage").when(F.col("held").isNull() | F.col("corrupt"), "corrupt").otherwise(F.coalesce("role", F.lit("orphan")))
    return ids.join(held, "id", "left").join(pointers, "id", "left").select("id", role.alias("role"))


def marks_after_refresh(marks: DataFrame, cues: DataFrame) -> DataFrame:
    """The marked cues that still exist after a rescan."""
    return marks.join(cues.select("path", "cue_id"), ["path", "cue_id"], "left_semi")


def marked_counts(cues: DataFrame, marks: DataFrame, visible: DataFrame) -> DataFrame:
    """One row per file: cues ``marked``, of them ``visible_marked`` under the present filter, and ``hidden_marked``."""
    key = ["path", "cue_id"]
    shown = visible.select(*key).distinct().withColumn("shown", F.lit(True))
    kept = cues.join(marks.select(*key).distinct(), key, "left_semi").join(shown, key, "left")
    seen = F.coalesce("shown", F.lit(False))
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("marked"), F.count_if(seen).alias("visible_marked"), F.count_if(~seen).alias("hidden_marked"))


def source_positions(visible: DataFrame, cues: DataFrame) -> DataFrame:
    """The source ``ordinal`` of each visible cue id, each once; ``unknown`` ids have none."""
    return visible.select("path", "cue_id").distinct().join(cues.select("path", "cue_id", "ordinal"), ["path", "cue_id"], "left").withColumn("unknown", F.col("ordinal").isNull())


def outside_targets(targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """The ``path`` of a transaction's targets that a scoped command may not touch."""
    return targets.select("path").distinct().join(allowed.select("path"), "path", "left_anti")


def request_size(plan: DataFrame) -> DataFrame:
    """One row: ``files`` and ``cues`` of a deletion request."""
    return plan.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size("cue_ids")), F.lit(0)).cast("bigint").alias("cues"))


def cumulative_progress(results: DataFrame) -> DataFrame:
    """``path``, ``completed``, ``deleted_so_far`` of results in the order of ``position``, as progress events add up."""
    sums = {"completed": F.lit(1).cast("bigint"), "deleted_so_far": F.col("deleted_cues").cast("bigint")}
    return running_totals(results, [F.col("position")], sums).select("path", "completed", "deleted_so_far")


def retained_numbers(cues: DataFrame, deleted: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """``path``, ``cue_id``, ``number`` (1, 2, ... in source order) of the cues that a deletion keeps; ``bound`` is that of ``number_in``."""
    kept = cues.join(deleted.select("path", "cue_id").distinct(), ["path", "cue_id"], "left_anti")
    return number_in(kept.select("path", "cue_id", "ordinal"), "path", ["ordinal", "cue_id"], "number", bound=bound).select("path", "cue_id", "number")
