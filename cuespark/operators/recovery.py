"""Stored transactions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuespark.workspace import Workspace

RECOVERY = (
    "place int, id string, role string, created_at string, status string, files bigint, changed bigint, file_paths array<string>, "
    "corrupt boolean, blocks_mutation boolean, error string"
)


def recovery_table(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """All transactions of a workspace, newest first (``place`` 0, 1, ...): what they are, whether they block, and their files in byte order.

    There is a row per change that is neither finished nor given up, and one for the undo point.
    """
    rows = [
        (n, i.id, i.role, i.created_at or None, i.status or None, i.files, i.changed, sorted(i.file_paths), i.corrupt, i.blocks_mutation, i.error or None)
        for n, i in enumerate(workspace.recoveries())
    ]
    return spark.createDataFrame(rows, RECOVERY)
