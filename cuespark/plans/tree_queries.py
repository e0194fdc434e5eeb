"""Queries that write the files of the tables to a tree, and scan, search and change them there."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.functions import detect_format
from cuespark.kernel.files import MOST_BYTES, read_safe
from cuespark.operators.discovery import Discovery, discover
from cuespark.operators.render import encode_file, render_files
from cuespark.plans.reference_queries import _ASS, _ASS_HEAD, _FOLD, _PLAIN, _SRT, _TAGS_ONLY, _VTT, _VTT_HEAD, _WHOLE_DISPLAY, Prepare, _cues, _plain, _whole, _whole_sql
from cuespark.session import Session
from cuespark.shared import shared_folder, snapshot
from cuespark.sources.tree import write_tree
from cuespark.streaming import stream_files
from cuespark.tables import load
from cuespark.workspace import Summary, Workspace

PHRASES = ["the ", "FEED", "café"]
ISSUE_KINDS = (None, "invalid", "symlink", "hardlink", "too-large", "unsafe")


def _write(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> str:
    """A file for each path of cues, in the format of its extension."""
    cues = prepare(_cues(spark, directory), detect_format(F.col("path"))).withColumn("form", detect_format(F.col("path")))
    root = shared_folder(spark, "tree")
    made = None
    for form in ("srt", "webvtt", "ass"):
        part = render_files(cues.where(F.col("form") == form), form, "plain", bound=load(spark, directory, "cues")).select("path", encode_file(F.col("body"), "utf-8").alias("content"))
        made = part if made is None else made.unionAll(part)
    write_tree(made, root)
    return root


def digest_now(root: str, path: Column) -> Column:
    """The digest that a file below ``root`` has when it is asked for; a file that can't be read is an error."""

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return pd.Series([read_safe(root, p).sha256 for p in paths], dtype=object)

    return digest.asNondeterministic()(path)


def _scan(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> Discovery:
    return discover(spark, _write(spark, directory, prepare))


def tree_scan(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    return _scan(spark, directory, prepare).files.select("path", "format", "encoding", F.col("cue_count").cast("bigint").alias("cues"), "size", "sha256")


def tree_issues(spark: SparkSession, directory: str) -> DataFrame:
    return _scan(spark, directory).issues.select("path", "kind")


def _spoil(root: str, path: str) -> None:
    """Makes the file an issue, of a kind that the length of its path gives; every sixth length leaves it as it is."""
    at = os.path.join(root, path)
    kind = ISSUE_KINDS[len(path) % len(ISSUE_KINDS)]
    if kind == "invalid":
        with open(at, "wb") as f:
            f.write(b"[Events]\nno record\n")
    elif kind == "symlink":
        os.rename(at, f"{at}.kept")
        os.symlink(os.path.basename(f"{at}.kept"), at)
    elif kind == "hardlink":
        os.link(at, f"{at}.kept")
    elif kind == "too-large":
        os.truncate(at, MOST_BYTES + 1)  # a hole, no blocks
    elif kind == "unsafe":
        os.remove(at)
        os.mkfifo(at)


def tree_issue_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """The issues of a tree in which files of each kind but unreadable stand; that kind needs rights which a superuser ignores."""
    root = _write(spark, directory)
    for r in _cues(spark, directory).where("end_ms > start_ms and start_ms >= 0").where(detect_format(F.col("path")).isNotNull()).select("path").distinct().toLocalIterator():
        _spoil(root, r.path)
    return discover(spark, root).issues.select("path", "kind")


def tree_search(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    session = Session(spark, Workspace(_write(spark, directory, prepare)))
    session.discover()
    found = session.search(PHRASES).matches
    return found.select("path", "ordinal", F.array_join(F.col("query_indexes").cast("array<string>"), ",").alias("indexes"))


def tree_remove_undo(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    """Removes all matches, undoes it, and gives per changed file what it was in between and whether it is as before."""
    root = _write(spark, directory, prepare)
    session = Session(spark, Workspace(root))
    before = session.discover().files.select("path", F.col("sha256").alias("before"))
    removed = _results(spark, session.remove(session.plan(session.search(PHRASES))))
    between = snapshot(removed.withColumn("sha256", digest_now(root, F.col("path"))))
    undone = _results(spark, session.workspace.undo()).select("path", F.col("status").alias("undone"))
    rows = between.join(undone, "path", "left").join(before, "path", "left")
    return rows.select("path", "status", "deleted_cues", "sha256", "undone", (digest_now(root, F.col("path")) == F.col("before")).alias("as_before"))


def _results(spark: SparkSession, summary: Summary) -> DataFrame:
    """``path``, ``status``, ``deleted_cues`` of a change, read from a file: the driver holds them no longer than it must."""
    at = os.path.join(shared_folder(spark, "results"), "results.jsonl")
    with open(at, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(json.dumps({"path": r.path, "status": r.status, "deleted_cues": r.deleted_cues}) + "\n" for r in summary.results)
    rows = spark.read.schema("path string, status string, deleted_cues int").json(f"file://{at}", lineSep="\n", mode="FAILFAST")
    return rows.repartition(spark.sparkContext.defaultParallelism, "path")


def tree_stream(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    """The same files read as a stream, drained once into a folder."""
    root, kept = _write(spark, directory, prepare), shared_folder(spark, "stream")
    files = stream_files(spark, root).select("path", "format", F.size("cues").cast("bigint").alias("cues"))
    query = files.writeStream.format("parquet").option("path", f"file://{kept}/out").option("checkpointLocation", f"file://{kept}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"file://{kept}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (tree_scan, tree_issues, tree_issue_kinds, tree_search, tree_remove_undo, tree_stream)} | {
    f"whole_{f.__name__}": functools.partial(f, prepare=_whole) for f in (tree_scan, tree_search, tree_remove_undo, tree_stream)
}

_FORM = "case lower(regexp_extract(path, '\\.[^./]*$')) when '.srt' then 'srt' when '.vtt' then 'webvtt' when '.ass' then 'ass' end"
_BODY = f"""case form when 'srt' then coalesce(string_agg({_SRT}, '' order by ordinal), '') when 'webvtt' then {_VTT_HEAD} || coalesce(string_agg({_VTT}, '' order by ordinal), '')
  else {_ASS_HEAD} || coalesce(string_agg({_ASS}, '' order by ordinal), '') end"""
_FORMED = f"{_PLAIN}, formed as (select *, {_FORM} as form from plain), listed as (select * from formed where form is not null)"
_MATCHED = f"""{_FORMED}, searched as (select *, {_FOLD.format("trim(regexp_replace(nfc_normalize(plain), ' +', ' ', 'g'))")} as search from listed),
matched as (select *, list_filter([case when contains(search, 'the') then '0' end, case when contains(search, 'feed') then '1' end, case when contains(search, 'café') then '2' end], lambda x: x is not null) as hits from searched)"""

ORACLES: dict[str, str] = {
    "tree_scan": f"""with {_FORMED}, bodies as (select path, form, count(*) as cues, {_BODY} as body from listed group by path, form)
select path, form as format, 'utf-8' as encoding, cues, cast(strlen(body) as bigint) as size, sha256(body) as sha256 from bodies""",
    "tree_issues": "select path, kind from issues where false",
    "tree_issue_kinds": f"""with {_FORMED} select distinct path, ['', 'invalid', 'symlink', 'hardlink', 'too-large', 'unsafe'][length(path) % 6 + 1] as kind from listed where length(path) % 6 <> 0""",
    "tree_search": f"with {_MATCHED} select path, cast(n - 1 as int) as ordinal, array_to_string(hits, ',') as indexes from matched where len(hits) > 0",
    "tree_remove_undo": f"""with {_MATCHED}, kept as (select path, form, ordinal, start_ms, end_ms, plain, row_number() over (partition by path order by ordinal) as n from matched where len(hits) = 0),
counts as (select path, form, count(*) as gone from matched where len(hits) > 0 group by path, form),
bodies as (select path, form, {_BODY} as body from kept group by path, form)
select c.path, 'succeeded' as status, cast(gone as int) as deleted_cues,
  sha256(coalesce(b.body, case c.form when 'srt' then '' when 'webvtt' then {_VTT_HEAD} else {_ASS_HEAD} end)) as sha256, 'restored' as undone, true as as_before
from counts c left join bodies b on c.path = b.path""",
    "tree_stream": f"with {_FORMED} select path, form as format, count(*) as cues from listed group by path, form",
}

_WHOLE = _whole_sql(f"case when {_FORM} = 'ass' then '' else {_TAGS_ONLY} end")
_PLAIN_DISPLAY = "trim(regexp_replace(nfc_normalize(plain), ' +', ' ', 'g'))"

ORACLES |= {f"whole_{name}": ORACLES[name].replace(_PLAIN, _WHOLE).replace(_PLAIN_DISPLAY, _WHOLE_DISPLAY) for name in ("tree_scan", "tree_search", "tree_remove_undo", "tree_stream")}
