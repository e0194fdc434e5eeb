"""Queries over texts with markup, entities, overrides, several lines, notes and settings; over all failures; and over changes as commands report them."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark import cli
from cuespark import functions as C
from cuespark import output as O
from cuespark.kernel.files import read_safe
from cuespark.kernel.formats import detect_format, parse
from cuespark.operators.discovery import discover
from cuespark.operators.parse import cues_of, issues_of, parse_files
from cuespark.operators.plan import conflicts, plan_faults, plan_files
from cuespark.operators.recovery import recovery_table
from cuespark.operators.render import HEADERS, encode_file, render_files
from cuespark.operators.rewrite import render_deletion
from cuespark.operators.search import search_any
from cuespark.plans.malformed import MALFORMED
from cuespark.plans.reference_queries import _FOLD, _FOUND, _LATEST, _ONCE, _PLAIN, _WHITE, _WHOLE_DISPLAY, _clock, _cues, _deleted, _files, _whole
from cuespark.plans.tree_queries import _BODY, _FORMED, _MATCHED, _PLAIN_DISPLAY, _WHOLE, PHRASES, _write, digest_now
from cuespark.session import Session
from cuespark.shared import shared_folder, snapshot
from cuespark.streaming import windowed_counts
from cuespark.tables import load
from cuespark.workspace import RECOVERY, FilePlan, Plan, Workspace, WorkspaceError

# How a text is dressed, by the remainder of its ordinal; "@" stands for the text. (raw, visible)
MARKUP = [
    ("<i>@</i>", "@"), ('<b><font color="#ff0">@</font></b>', "@"), ("@<br>@", "@ @"), ("@\n@", "@\n@"), ("<c.yellow.bg>@</c> <v Bob>@", "@ @"), ("<custom>@</custom>", "<custom>@</custom>"),
    ("&lt;@&gt; &amp; &#233;&#x42; &nbsp;x", "<@> & éB \u00a0x"), ("3 < 5 @", "3 < 5 @"), ("<00:00:01.000>@", "<00:00:01.000>@"), ("{\\an8}@", "{\\an8}@"), ("<v.loud Bob>@ < b >x</ b >", "<v.loud Bob>@ x"),
]
TIMED_MARKUP = [*MARKUP[:8], ("<00:00:01.000>@", "@"), *MARKUP[9:]]
OVERRIDES = [
    ("{\\i1}@{\\i0}", "@"), ("@\\N@\\h@", "@ @ @"), ("{\\p1}m 0 0 l 1 1{\\p0}@", "@"), ("@ {open", "@ {open"), ("@, @, and @", "@, @, and @"), ("<i>@</i> &amp;", "<i>@</i> &amp;"),
    ("{\\pos(1,2)\\P 1}hidden{\\p0}@", "@"), ("@\\n@", "@ @"), ("{comment}@{}", "@"), ("@", "@"),
]
DRESS = {"srt": MARKUP, "webvtt": TIMED_MARKUP, "ass": OVERRIDES}


def _line(text: Column) -> Column:
    """A cue's text on one line; one that shows nothing is ``q``."""
    line = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", " ")
    return F.when(C.is_blank(line), "q").otherwise(line)


def _dressed(form: str, which: int = 0) -> Column:
    dress = F.array(*[F.lit(d[which]) for d in DRESS[form]])
    return F.replace(F.get(dress, F.col("ordinal") % len(DRESS[form])), F.lit("@"), _line(F.col("display_text")))


def markup_projection(spark: SparkSession, directory: str) -> DataFrame:
    """What shows of every cue's text in markup: as in SRT, as in WebVTT."""
    cues = load(spark, directory, "cues").where("ordinal is not null")
    return cues.select("row_id", C.visible_markup(_dressed("srt")).alias("srt"), C.visible_markup(_dressed("webvtt"), True).alias("vtt"))


def ass_projection(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "cues").where("ordinal is not null").select("row_id", C.visible_ass(_dressed("ass")).alias("ass"))


def _marked(spark: SparkSession, directory: str, form: str) -> DataFrame:
    cues = _cues(spark, directory).where("end_ms >= start_ms and start_ms >= 0")
    return cues.withColumn("marked", _dressed(form)).select("path", "ordinal", "start_ms", "end_ms", "marked")


NOTES = "WEBVTT about\nKind: captions\n\nSTYLE\n::cue { color: red }\n\nREGION\nid:fred\n\nnote\tseveral\nlines\n\n"
FIELDS = "; made\n[Script Info]\nTitle: x\n\n[Events]\nComment: nothing\nFormat: Start, Style, End, Text\n"


def _marked_files(spark: SparkSession, directory: str, form: str, lines: str, encoding: str) -> DataFrame:
    """The files of dressed cues: WebVTT with notes, ids and settings, ASS with another order of fields."""
    extra = F.when(F.col("n") % 4 == 0, "NOTE between\ncues\n\n").otherwise("") if form == "webvtt" else None
    header = NOTES if form == "webvtt" else None
    body = F.col("body")
    files = render_files(_marked(spark, directory, form), form, "marked", extra, header, load(spark, directory, "cues"))
    if form == "webvtt":
        body = F.regexp_replace(body, r"(?m)^([0-9:.]+ --> [0-9:.]+)$", "intro 1\n$1 align:start position:10%")
    if form == "ass":
        body = F.concat(F.lit(FIELDS), F.regexp_replace(F.substring(body, len(HEADERS["ass"]) + 1, 2**31 - 1), r"(?m)^Dialogue: 0,([0-9:.]+),([0-9:.]+),Default,", " dialogue :$1, Default ,$2,"))
    if lines != "\n":
        body = F.replace(body, F.lit("\n"), F.lit(lines))
    return files.select("path", encode_file(body, encoding).alias("content"))


def _marked_again(form: str, lines: str = "\n", encoding: str = "utf-8"):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        parsed = parse_files(_marked_files(spark, directory, form, lines, encoding), form=F.lit(form))
        return cues_of(parsed).select("path", "ordinal", "start_ms", "end_ms", "display_text", "search_text")

    return query


def cue_spans_utf16(spark: SparkSession, directory: str) -> DataFrame:
    """The bytes that each cue takes in a UTF-16 file."""
    cues = cues_of(parse_files(_marked_files(spark, directory, "srt", "\n", "utf-16le-bom"), form=F.lit("srt")))
    return cues.select("path", "ordinal", F.col("delete_span.start").alias("first"), F.col("delete_span.end").alias("last"), (F.col("index_span.end") - F.col("index_span.start")).alias("digits"))


def delete_render_utf16(spark: SparkSession, directory: str) -> DataFrame:
    """Every third cue deleted from UTF-16 files, big-endian; the result as text, and its size."""
    files = snapshot(_marked_files(spark, directory, "srt", "\n", "utf-16be-bom")).withColumn("format", F.lit("srt"))
    cues = cues_of(parse_files(files, form=F.lit("srt")))
    plan = cues.where("ordinal % 3 = 1").groupBy("path").agg(F.array_sort(F.collect_list("cue_id")).alias("cue_ids"))
    made = render_deletion(files, plan)
    text = F.decode(F.substring("rendered", 3, 2**31 - 1), "UTF-16BE")
    return made.select("path", F.sha2(text, 256).alias("sha256"), F.octet_length("rendered").cast("bigint").alias("size"), F.hex(F.substring("rendered", 1, 2)).alias("mark"), "deleted_cues", "valid")


def malformed_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """Each failure: every path has one of the contents of ``MALFORMED``, by its length."""
    paths = load(spark, directory, "cues").select("path").distinct().where("path is not null")
    bad = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(c).cast("binary").alias("content")) for f, c, _, _ in MALFORMED])
    files = paths.withColumn("bad", F.get(bad, F.length("path") % len(MALFORMED))).select("path", "bad.form", "bad.content")
    return issues_of(parse_files(files, form=F.col("form"))).select("path", "kind", F.col("error_line").cast("int").alias("error_line"), "error")


def malformed_each(spark: SparkSession, directory: str) -> DataFrame:
    """All failures once, whatever paths there are."""
    files = spark.createDataFrame([(str(i), f, bytearray(c)) for i, (f, c, _, _) in enumerate(MALFORMED)], "path string, form string, content binary")
    return issues_of(parse_files(files, form=F.col("form"))).select("path", F.coalesce("error_line", F.lit(0)).cast("int").alias("error_line"), "error")


def line_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """Every line of the documents: blank, digits only, a number with blanks around it, the begin of a note, style or region."""
    lines = load(spark, directory, "documents").where("text is not null").select("doc_id", F.posexplode(C.line_array(F.col("text"))).alias("line_no", "line"))
    line = F.col("line")
    return lines.select("doc_id", "line_no", C.is_blank(line).alias("blank"), C.is_digits(line).alias("digits"), C.numeric_token(line).alias("token"), C.vtt_metadata(line).alias("metadata"))


def relative_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Paths as they are, and changed so that they could lead out of their root."""
    shapes = F.array(F.col("path"), F.concat(F.lit("/"), "path"), F.concat(F.lit("../"), "path"), F.concat("path", F.lit("/.")), F.replace("path", F.lit("/"), F.lit("//")))
    paths = load(spark, directory, "scan_files").select("path").distinct().select(F.posexplode(shapes).alias("shape", "shown"))
    return paths.select("shape", "shown", C.safe_relative(F.col("shown")).alias("safe"))


def cue_views(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "cues").select("row_id", C.cue_view(F.col("start_ms"), F.col("end_ms"), F.col("display_text")).alias("shown"))


def display_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The first three lines of every document in a view that is wide enough for any."""
    window = C.line_window(F.col("text"), 1_000_000, 0, 3)
    return load(spark, directory, "documents").where("text is not null").select("doc_id", window.alias("w")).select("doc_id", F.array_join("w.lines", "|").alias("lines"), "w.after")


# plans


def _requests(spark: SparkSession, directory: str) -> DataFrame:
    plan = plan_files(_deleted(spark, directory), _files(spark, directory), "all", 1)
    return plan.withColumn("case", F.length("path") % 6)


def plan_fault_list(spark: SparkSession, directory: str) -> DataFrame:
    """Requests with a fault each by the length of their path: repeated, unknown path, empty, a cue twice, a cue that wasn't reviewed."""
    plan = _requests(spark, directory)
    ids = F.when(F.col("case") == 3, F.array().cast("array<string>")).when(F.col("case") == 4, F.concat("cue_ids", F.slice("cue_ids", 1, 1))).when(F.col("case") == 5, F.concat("cue_ids", F.array(F.lit("srt:0:0:0")))).otherwise(F.col("cue_ids"))
    asked = plan.withColumn("path", F.when(F.col("case") == 2, F.concat(F.lit("no/"), "path")).otherwise(F.col("path"))).withColumn("cue_ids", ids)
    asked = asked.unionAll(asked.where(F.col("case") == 1))
    return plan_faults(asked, _files(spark, directory), _deleted(spark, directory)).where("not (startswith(path, 'no/') and fault = 'cue outside of the reviewed matches')")


def plan_conflicts(spark: SparkSession, directory: str) -> DataFrame:
    """A plan against the files as they are later: some gone, some with other bytes, some with another identity."""
    files, case = _files(spark, directory), F.length("path") % 4
    other = F.struct(F.col("identity.kind").alias("kind"), F.col("identity.volume").alias("volume"), (F.coalesce(F.col("identity.object"), F.lit(0)) + 1).cast("decimal(20,0)").alias("object"))
    later = files.where(case != 1).withColumn("sha256", F.when(case == 2, F.lit("0")).otherwise(F.col("sha256"))).withColumn("identity", F.when(case == 3, other).otherwise(F.col("identity")))
    return conflicts(plan_files(_deleted(spark, directory), files, "all", 1), later)


def plan_focused(spark: SparkSession, directory: str) -> DataFrame:
    """The plan of one file in focus: the one with the most matches, the first of them."""
    matches = _deleted(spark, directory)
    focus = matches.groupBy("path").count().orderBy(F.desc("count"), "path").select("path").limit(1)
    return plan_files(matches, _files(spark, directory), "focused", 1, focus).select("path", "scope", F.array_join("cue_ids", ",").alias("cue_ids"))


def phrases_usable(spark: SparkSession, directory: str) -> DataFrame:
    """Matches of a list in which only one phrase has text."""
    return search_any(load(spark, directory, "cues"), ["", " \t", "\u3000", "THE  reel"]).select("row_id", F.array_join(F.col("query_indexes").cast("array<string>"), ",").alias("indexes"))


def scan_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Valid files and files kept out, of all that were scanned."""
    valid = _files(spark, directory).agg(F.count(F.lit(1)).alias("valid"), F.coalesce(F.sum("cue_count"), F.lit(0)).alias("cues"))
    return valid.crossJoin(load(spark, directory, "issues").agg(F.count_distinct("path").alias("invalid")))  # each side is one row


def delete_unknown(spark: SparkSession, directory: str) -> DataFrame:
    """A cue that no file has can't be deleted."""
    files = _marked_files(spark, directory, "srt", "\n", "utf-8").withColumn("format", F.lit("srt"))
    plan = files.select("path", F.array(F.concat(F.lit("srt:"), "path")).alias("cue_ids"))
    return render_deletion(files, plan).select("path", "valid", "error", F.col("rendered").isNull().alias("nothing"))


def windowed_scans(spark: SparkSession, directory: str) -> DataFrame:
    """The scanned files as a stream, counted by day and format."""
    schema = load(spark, directory, "scan_files").schema
    kept = shared_folder(spark, "windows")
    stream = spark.readStream.schema(schema).parquet(f"{directory}/scan_files.parque[t]")
    counts = windowed_counts(stream.where("scanned_at is not null"), "scanned_at", "30 days", "1 day", "format").select(F.floor(F.col("window.start").cast("bigint") / 86_400).cast("bigint").alias("day"), "format", "rows")
    out = f"file://{kept}/out"
    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"file://{kept}/log").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.parquet(out)


# commands on a tree


def _run(spark: SparkSession, *args: str) -> dict:
    out = io.StringIO()
    cli.run([*args, "--json"], lambda: spark, out, io.StringIO())
    return json.loads(out.getvalue())


def _print(spark: SparkSession, *args: str) -> str:
    """Runs a command whose output may be large; gives the file that it was printed to, in a folder that all executors share."""
    at = os.path.join(shared_folder(spark, "printed"), "out")
    with open(at, "w", encoding="utf-8", newline="\n") as out, open(os.devnull, "w") as err:
        cli.run([*args], lambda: spark, out, err)
    return at


def _run_apart(spark: SparkSession, key: str, *args: str) -> tuple[dict, str]:
    """The JSON document of a command without its records under ``key``, and a file of these, one a line."""
    printed = _print(spark, *args, "--json")
    at = os.path.join(os.path.dirname(printed), f"{key}.jsonl")
    with open(printed, encoding="utf-8", newline="") as document, open(at, "w", encoding="utf-8", newline="\n") as lines:
        return O.read_json(document, key, lambda record: lines.write(record + "\n")), at


def cli_scan(spark: SparkSession, directory: str) -> DataFrame:
    root = _write(spark, directory, _whole)
    rows = _run(spark, "scan", "-d", root)["files"]
    return spark.createDataFrame([(i, r["path"], r["format"], r["encoding"], r["cues"], r["size"]) for i, r in enumerate(rows)], "place int, path string, format string, encoding string, cues bigint, size bigint")


def _smallest(root: str) -> str:
    found = sorted(os.path.relpath(os.path.join(at, n), root) for at, _, names in os.walk(root) for n in names)
    return next(p for p in found if not p.startswith("."))


def cli_scan_file(spark: SparkSession, directory: str) -> DataFrame:
    """One file named on the command line: the first by its path."""
    root = _write(spark, directory, _whole)
    shown = _run(spark, "scan", "-f", os.path.join(root, _smallest(root)))
    rows = [(shown["status"], shown["target"]["kind"], os.path.basename(shown["target"]["path"]), r["format"], r["cues"]) for r in shown["files"]]
    return spark.createDataFrame(rows, "status string, kind string, name string, format string, cues bigint")


def scan_one_file(spark: SparkSession, directory: str) -> DataFrame:
    root = _write(spark, directory, _whole)
    return discover(spark, root, file=_smallest(root)).files.select("path", "format", F.col("cue_count").cast("bigint").alias("cues"))


def cli_search(spark: SparkSession, directory: str) -> DataFrame:
    _, matches = _run_apart(spark, "matches", "search", "-d", _write(spark, directory, _whole), *PHRASES)
    rows = spark.read.schema("path string, start_ms bigint, end_ms bigint, matched_phrases array<string>").json(f"file://{matches}", lineSep="\n", mode="FAILFAST")
    return rows.select("path", "start_ms", "end_ms", F.array_join("matched_phrases", "|").alias("phrases"))


def cli_dry_run(spark: SparkSession, directory: str) -> DataFrame:
    """The summary of a removal that isn't carried out; no byte changes."""
    root = _write(spark, directory, _whole)
    before = discover(spark, root).files.select("path", "sha256")
    shown, _ = _run_apart(spark, "matches", "remove", "-d", root, "--dry-run", *PHRASES)
    same = before.withColumn("now", digest_now(root, F.col("path"))).where("now <> sha256").isEmpty()
    s = shown["summary"]
    return spark.createDataFrame([(shown["dry_run"], s["matching_cues"], s["matching_files"], s["scanned_files"], same)], "dry_run boolean, cues bigint, files bigint, scanned bigint, same boolean")


def cli_remove(spark: SparkSession, directory: str) -> DataFrame:
    shown = _run(spark, "remove", "-d", _write(spark, directory, _whole), *PHRASES)
    return spark.createDataFrame([(i, r["path"], r["status"], r["deleted_cues"]) for i, r in enumerate(shown["results"])], "place int, path string, status string, deleted_cues bigint")


def cli_undo(spark: SparkSession, directory: str) -> DataFrame:
    """A removal undone, and what a second undo says."""
    root = _write(spark, directory, _whole)
    _run(spark, "remove", "-d", root, *PHRASES)
    first, second = _run(spark, "undo", "-d", root), _run(spark, "undo", "-d", root)
    return spark.createDataFrame([(first["status"], first["summary"]["restored"], len(first["results"]), second["status"])], "status string, restored bigint, results bigint, again string")


def _interrupted(spark: SparkSession, directory: str) -> str:
    """A tree with a complete removal, and a later one that ended after its first file."""
    root = _write(spark, directory, _whole)
    _run(spark, "remove", "-d", root, *PHRASES)
    plans = []
    for path in sorted(p for p in (os.path.relpath(os.path.join(at, n), root) for at, _, names in os.walk(root) for n in names) if not p.startswith(".")):
        got = read_safe(root, path)
        cues = parse(got.data, detect_format(path)).cues
        if cues:
            plans.append(FilePlan(path, got.sha256, got.identity, (cues[0].cue_id,)))
        if len(plans) == 2:
            break
    begun = Workspace(root).begin(Plan(tuple(plans)))
    begun.apply_one()
    begun.abandon()
    return root


def recovery_frame(spark: SparkSession, directory: str) -> DataFrame:
    return recovery_table(spark, Workspace(_interrupted(spark, directory))).select("place", "role", "status", "files", "changed", "blocks_mutation", F.size("file_paths").cast("bigint").alias("paths"))


def cli_recovery(spark: SparkSession, directory: str) -> DataFrame:
    """Recoveries as listed, the pending one restored, the rest discarded; what is listed after each."""
    root = _interrupted(spark, directory)
    rows = []
    for step in ("list", "restore", "discard"):
        items = _run(spark, "recovery", "list", "-d", root)["recoveries"]
        rows.append((step, len(items), ",".join(i["role"] for i in items)))
        if step != "list":
            _run(spark, "recovery", step, "-d", root, items[0]["id"])
    rows.append(("end", len(_run(spark, "recovery", "list", "-d", root)["recoveries"]), ""))
    return spark.createDataFrame(rows, "step string, items bigint, roles string")


def _code(call: Callable, *args: object, **named: object) -> str:
    try:
        call(*args, **named)
    except WorkspaceError as e:
        return e.code
    return "accepted"


def journal_cases(spark: SparkSession, directory: str) -> DataFrame:
    """What becomes of changes that ended early, and what is refused meanwhile: ``case`` and ``outcome``."""
    root = _interrupted(spark, directory)
    roles = lambda: ",".join(i.role for i in Workspace(root).recoveries())
    rows = [("a change that ended after a file is pending", roles()), ("and blocks", _code(Workspace(root).begin, Plan((_first_plan(root),))))]
    os.unlink(os.path.join(root, RECOVERY, "state.json"))
    rows.append(("pointers lost: the newest of each kind are adopted", roles()))
    undo = Workspace(root).undo_info()
    rows.append(("a change out of scope is refused", _code(Workspace(root).restore_recovery, Workspace(root).recoveries()[0].id, allowed=["other.srt"])))
    Workspace(root).discard_recovery(Workspace(root).recoveries()[0].id)
    rows.append(("discarding it without proof of the order retires the undo point too", roles()))
    begun = Workspace(root).begin(Plan((_first_plan(root),)))
    rows.append(("a second writer is refused", _code(Workspace(root).state)))
    begun.abandon()
    rows.append(("a change without effect is retired", roles()))
    rows.append(("nothing to undo", _code(Workspace(root).undo)))
    rows.append(("files of the adopted undo point", "some" if undo.file_paths else "none"))
    Workspace(root).apply(Plan((_first_plan(root),)))
    with open(os.path.join(root, RECOVERY, Workspace(root).undo_info().id, "manifest.json"), "ab") as f:
        f.write(b"x")
    rows.append(("an unreadable change is kept", roles()))
    rows.append(("and told", str(len(Workspace(root).cleanup_session()))))
    return spark.createDataFrame(rows, "case string, outcome string")


def _first_plan(root: str) -> FilePlan:
    for path in sorted(p for p in (os.path.relpath(os.path.join(at, n), root) for at, _, names in os.walk(root) for n in names) if not p.startswith(".")):
        got = read_safe(root, path)
        if cues := parse(got.data, detect_format(path)).cues:
            return FilePlan(path, got.sha256, got.identity, (cues[0].cue_id,))
    raise ValueError("no file has a cue")


def session_cases(spark: SparkSession, directory: str) -> DataFrame:
    """Which requests a session accepts: ``case`` and the code of the refusal, or ``accepted``."""
    session = Session(spark, Workspace(_write(spark, directory, _whole)))
    rows = [("a search before any scan", _code(session.search, PHRASES))]
    session.discover()
    review = session.search(PHRASES)
    plan = session.plan(review)
    path = plan.files[0].path
    asked = spark.createDataFrame([(path, [*plan.files[0].cue_ids, "srt:0:0:0"])], "path string, cue_ids array<string>")
    rows.append(("a cue that wasn't reviewed", _code(session.check_request, asked, review)))
    rows.append(("reviewed cues", _code(session.check_request, asked.withColumn("cue_ids", F.array_except("cue_ids", F.array(F.lit("srt:0:0:0")))), review)))
    session.discover()
    rows += [("a plan of an earlier scan", _code(session.remove, plan)), ("a review of an earlier scan", _code(session.plan, review))]
    opened = session.open_editor(path)
    cue = opened.cues.orderBy("ordinal").first().cue_id
    rows += [
        ("a file that isn't there", _code(session.open_editor, "no.srt")), ("no token", _code(session.search_editor, "", "x")), ("another token", _code(session.search_editor, "editor-x", "x")),
        ("another path", _code(session.remove_in_editor, opened.token, "no.srt", [cue])), ("a cue twice", _code(session.remove_in_editor, opened.token, path, [cue, cue])),
        ("the open file", _code(session.remove_in_editor, opened.token, path, [cue])), ("the same token again", _code(session.remove_in_editor, opened.token, path, [cue])),
    ]
    return spark.createDataFrame(rows, "case string, outcome string")


def cli_codes(spark: SparkSession, directory: str) -> DataFrame:
    """The exit codes of commands: ``case``, ``code`` and how many bytes are printed (none or some) with ``--quiet`` and without."""
    root = _write(spark, directory, _whole)
    with open(os.path.join(root, "unreadable.srt"), "wb") as f:
        f.write(b"no cue")
    cases = {
        "a scan with an issue": ["scan", "-d", root], "one file without issue": ["scan", "-f", os.path.join(root, _smallest(root))], "nothing found": ["search", "-f", os.path.join(root, _smallest(root)), "qqq zzz qqq"],
        "no target": ["scan"], "a blank phrase": ["search", "-d", root, " "], "no directory": ["scan", "-d", os.path.join(root, "no")], "an unknown transaction": ["recovery", "restore", "-d", root, "tx-0"],
        "nothing to undo": ["undo", "-d", root], "version": ["version"], "recoveries of one file": ["recovery", "list", "-f", os.path.join(root, _smallest(root))],
    }
    rows = []
    for case, args in cases.items():
        out, err, quiet = io.StringIO(), io.StringIO(), io.StringIO()
        code = cli.run(args, lambda: spark, out, err)
        said = "both" if out.getvalue() and err.getvalue() else "output" if out.getvalue() else "error" if err.getvalue() else "nothing"
        if {"-d", "-f"} & set(args):
            cli.run([*args, "-q"], lambda: spark, quiet, io.StringIO())
        rows.append((case, code, said, quiet.getvalue() == ""))
    return spark.createDataFrame(rows, "case string, code int, said string, quiet boolean")


def cli_lines(spark: SparkSession, directory: str) -> DataFrame:
    """The lines that a search prints for people."""
    printed = _print(spark, "search", "-d", _write(spark, directory, _whole), *PHRASES)
    # a line holds no other line end: texts are printed without controls
    return spark.read.text(f"file://{printed}", lineSep="\n").select(F.col("value").alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        markup_projection, ass_projection, cue_spans_utf16, delete_render_utf16, malformed_kinds, malformed_each, line_kinds, relative_paths, cue_views, display_lines, plan_fault_list, plan_conflicts, plan_focused,
        phrases_usable, scan_counts, delete_unknown, windowed_scans, cli_scan, cli_scan_file, scan_one_file, cli_search, cli_dry_run, cli_remove, cli_undo, recovery_frame, cli_recovery, cli_lines, cli_codes, journal_cases, session_cases,
    )
} | {
    "marked_roundtrip_srt": _marked_again("srt"), "marked_roundtrip_vtt": _marked_again("webvtt"), "marked_roundtrip_ass": _marked_again("ass"),
    "marked_roundtrip_crlf": _marked_again("srt", "\r\n", "utf-8-bom"), "marked_roundtrip_utf16": _marked_again("webvtt", "\r", "utf-8-bom"), "marked_roundtrip_utf16_ass": _marked_again("ass", "\r\n", "utf-16le-bom"),
}

_TEXT = rf"regexp_replace(coalesce(display_text, ''), '\r\n|\r|\n', ' ', 'g')"
_SHOWN_TEXT = f"case when trim(regexp_replace({_TEXT}, '{_WHITE}', ' ', 'g')) = '' then 'q' else {_TEXT} end"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _dress_sql(form: str, which: int) -> str:
    listed = ", ".join(_literal(d[which]) for d in DRESS[form])
    return f"replace([{listed}][ordinal % {len(DRESS[form])} + 1], '@', {_SHOWN_TEXT})"


_MARKED = f"{_ONCE}, marked as (select *, row_number() over (partition by path order by ordinal) as n from once where end_ms >= start_ms and start_ms >= 0)"


def _marked_sql(form: str) -> str:
    shown = f"trim(regexp_replace(nfc_normalize({_dress_sql(form, 1)}), '{_WHITE}', ' ', 'g'))"
    return f"with {_MARKED} select path, cast(n - 1 as int) as ordinal, start_ms, end_ms, {shown} as display_text, {_FOLD.format(shown)} as search_text from marked"


_SRT_BLOCK = f"n || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || {_dress_sql('srt', 0)} || chr(10) || chr(10)"
# characters beyond the first plane take two units
_UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
_KINDS = ", ".join(f"{{'line': {line or 'null'}, 'at': {_literal(f':{line}: ' if line else ': ')}, 'message': {_literal(m)}}}" for _, _, line, m in MALFORMED)

ORACLES: dict[str, str] = {
    "markup_projection": f"select row_id, {_dress_sql('srt', 1)} as srt, {_dress_sql('webvtt', 1)} as vtt from cues where ordinal is not null",
    "ass_projection": f"select row_id, {_dress_sql('ass', 1)} as ass from cues where ordinal is not null",
    "marked_roundtrip_srt": _marked_sql("srt"), "marked_roundtrip_vtt": _marked_sql("webvtt"), "marked_roundtrip_ass": _marked_sql("ass"),
    "marked_roundtrip_crlf": _marked_sql("srt"), "marked_roundtrip_utf16": _marked_sql("webvtt"), "marked_roundtrip_utf16_ass": _marked_sql("ass"),
    "cue_spans_utf16": f"""with {_MARKED}, blocks as (select path, n, {_SRT_BLOCK} as block from marked),
sized as (select path, n, 2 * {_UNITS.format('block')} as size from blocks), placed as (select *, 2 + sum(size) over (partition by path order by n) as last from sized)
select path, cast(n - 1 as int) as ordinal, cast(last - size as bigint) as first, cast(last as bigint) as last, cast(2 * length(n::varchar) as bigint) as digits from placed""",
    "delete_render_utf16": f"""with {_MARKED}, kept as (select path, ordinal, display_text, start_ms, end_ms, row_number() over (partition by path order by ordinal) as n from marked where (n - 1) % 3 <> 1),
bodies as (select path, string_agg({_SRT_BLOCK}, '' order by n) as body from kept group by path), counts as (select path, count(*) filter ((n - 1) % 3 = 1) as gone from marked group by path)
select path, sha256(body) as sha256, cast(2 + 2 * {_UNITS.format('body')} as bigint) as size, 'FEFF' as mark, cast(gone as int) as deleted_cues, true as valid from bodies join counts using (path) where gone > 0""",
    "malformed_kinds": f"""with paths as (select distinct path, [{_KINDS}][length(path) % {len(MALFORMED)} + 1] as bad from cues where path is not null)
select path, 'invalid' as kind, cast(bad.line as int) as error_line, path || bad.at || bad.message as error from paths""",
    "malformed_each": f"""with numbered as (select unnest([{_KINDS}]) as bad, unnest(range(0, {len(MALFORMED)})) as i)
select i::varchar as path, cast(coalesce(bad.line, 0) as int) as error_line, i || bad.at || bad.message as error from numbered""",
    "line_kinds": rf"""with split as (select doc_id, string_split_regex(text, '\r\n|\r|\n') as l from documents where text is not null),
cut as (select doc_id, case when l[len(l)] = '' then l[1:len(l) - 1] else l end as l from split),
lines as (select doc_id, cast(unnest(range(0, len(l))) as int) as line_no, unnest(l) as line from cut), bare as (select *, trim(regexp_replace(line, '{_WHITE}', ' ', 'g')) as b from lines)
select doc_id, line_no, b = '' as blank, regexp_full_match(line, '[0-9]+') as digits, nullif(regexp_extract(line, '^[ \t]*([0-9]+)[ \t]*$', 1), '') as token,
  (upper(b) in ('NOTE', 'STYLE', 'REGION') or regexp_matches(upper(line), '^{_WHITE[:-1]}*NOTE[ \t]')) as metadata from bare""",
    "relative_paths": """with paths as (select distinct path from scan_files),
shapes as (select unnest([path, '/' || path, '../' || path, path || '/.', replace(path, '/', '//')]) as shown, cast(unnest(range(0, 5)) as int) as shape, path from paths)
select shape, shown, shape = 0 or (shape = 4 and not contains(path, '/')) as safe from shapes""",
    "cue_views": f"select row_id, {_clock('start_ms')} || ' → ' || {_clock('end_ms')} || '  ' || display_text as shown from cues",
    "plan_fault_list": f"""with {_FOUND}, {_LATEST}, planned as (select distinct l.path, length(l.path) % 6 as k from found f join latest l on f.path = l.path)
select case k when 2 then 'no/' else '' end || path as path,
  ['', 'duplicate target', 'path is not indexed', 'no cues selected', 'duplicate cue', 'cue outside of the reviewed matches'][k + 1] as fault from planned where k > 0""",
    "plan_conflicts": f"""with {_FOUND}, {_LATEST} select distinct l.path, case when length(l.path) % 4 = 0 then 'ready' else 'conflicted' end as status from found f join latest l on f.path = l.path""",
    "plan_focused": f"""with {_FOUND}, {_LATEST}, focus as (select path from found group by path order by count(*) desc, path limit 1)
select l.path, 'focused' as scope, string_agg(cue_id, ',' order by ordinal) as cue_ids from found f join latest l on f.path = l.path where l.path in (select path from focus) group by l.path""",
    "phrases_usable": "select row_id, '0' as indexes from cues where contains(search_text, 'the reel')",
    "scan_counts": f"with {_LATEST} select count(*) as valid, cast(coalesce(sum(cue_count), 0) as bigint) as cues, (select count(distinct path) from issues) as invalid from latest",
    "delete_unknown": f"with {_MARKED} select distinct path, false as valid, 'unknown cue ID \"srt:' || path || '\"' as error, true as nothing from marked",
    "windowed_scans": "select cast(floor(epoch(scanned_at) / 86400) as bigint) as day, format, count(*) as rows from scan_files where scanned_at is not null group by all",
}

_FILES = _FORMED.replace(_PLAIN, _WHOLE)
_HITS = _MATCHED.replace(_PLAIN, _WHOLE).replace(_PLAIN_DISPLAY, _WHOLE_DISPLAY)
_SPELLED = f"list_transform(hits, lambda h: [{', '.join(map(_literal, PHRASES))}][h::int + 1])"
_SANE = r"regexp_replace({}, '[\x00-\x1F\x7F-\x{{9F}}\x{{61C}}\x{{200E}}\x{{200F}}\x{{2028}}-\x{{202E}}\x{{2066}}-\x{{206F}}]', '�', 'g')"
_FIRST = "path = (select min(path) from listed)"
_COUNTS = f"{_HITS}, found as (select * from matched where len(hits) > 0), counted as (select count(*) as cues, count(distinct path) as files, (select count(distinct path) from listed) as scanned from found)"

ORACLES |= {
    "cli_scan": f"""with {_FILES}, bodies as (select path, form, count(*) as cues, {_BODY} as body from listed group by path, form)
select cast(row_number() over (order by lower(path), path) - 1 as int) as place, path, form as format, 'utf-8' as encoding, cues, cast(strlen(body) as bigint) as size from bodies""",
    "cli_scan_file": f"with {_FILES} select 'ok' as status, 'file' as kind, regexp_extract(path, '[^/]*$') as name, form as format, count(*) as cues from listed where {_FIRST} group by path, form",
    "scan_one_file": f"with {_FILES} select path, form as format, count(*) as cues from listed where {_FIRST} group by path, form",
    "cli_search": f"with {_HITS} select path, start_ms, end_ms, array_to_string({_SPELLED}, '|') as phrases from matched where len(hits) > 0",
    "cli_dry_run": f"with {_COUNTS} select true as dry_run, cues, files, scanned, true as same from counted",
    "cli_remove": f"with {_COUNTS} select cast(row_number() over (order by path) - 1 as int) as place, path, 'succeeded' as status, count(*) as deleted_cues from found group by path",
    "cli_undo": f"with {_COUNTS} select 'ok' as status, files as restored, files as results, 'empty' as again from counted",
    "recovery_frame": f"""with {_COUNTS} select 0 as place, 'pending' as role, 'active' as status, 2::bigint as files, 1::bigint as changed, true as blocks_mutation, 2::bigint as paths
union all select 1, 'undo', 'complete', files, files, false, files from counted""",
    "cli_recovery": "select * from (values ('list', 2::bigint, 'pending,undo'), ('restore', 2, 'pending,undo'), ('discard', 1, 'undo'), ('end', 0, '')) as t(step, items, roles)",
    "cli_lines": f"""with {_COUNTS} select 'MATCH ' || path || '  ' || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || '  ' || {_SANE.format(_WHOLE_DISPLAY)} || '  phrases=' || array_to_string({_SPELLED}, ',') as line from found
union all select 'SUMMARY cues=' || cues || ' files=' || files || ' scanned=' || scanned || ' issues=0' from counted""",
    "display_lines": rf"""with split as (select doc_id, string_split_regex(text, '\r\n|\r|\n') as l from documents where text is not null),
cut as (select doc_id, case when len(l) > 1 and l[len(l)] = '' then l[1:len(l) - 1] else l end as l from split)
select doc_id, array_to_string(list_transform(l[1:3], lambda x: {_SANE.format('x')}), '|') as lines, len(l) > 3 as after from cut""",
    "journal_cases": """select * from (values ('a change that ended after a file is pending', 'pending,undo'), ('and blocks', 'recovery-pending'), ('pointers lost: the newest of each kind are adopted', 'pending,undo'),
  ('a change out of scope is refused', 'scope'), ('discarding it without proof of the order retires the undo point too', ''), ('a second writer is refused', 'locked'), ('a change without effect is retired', ''),
  ('nothing to undo', 'no-undo'), ('files of the adopted undo point', 'some'), ('an unreadable change is kept', 'corrupt'), ('and told', '1')) as t("case", outcome)""",
    "cli_codes": """select * from (values ('a scan with an issue', 4, 'both', true), ('one file without issue', 0, 'output', true), ('nothing found', 1, 'output', true), ('no target', 2, 'error', true),
  ('a blank phrase', 2, 'error', true), ('no directory', 2, 'error', true), ('an unknown transaction', 3, 'error', true), ('nothing to undo', 1, 'error', true), ('version', 0, 'output', true),
  ('recoveries of one file', 0, 'output', true)) as t("case", code, said, quiet)""",
    "session_cases": """select * from (values ('a search before any scan', 'no-scan'), ('a cue that wasn''t reviewed', 'not-reviewed'), ('reviewed cues', 'accepted'), ('a plan of an earlier scan', 'stale-plan'),
  ('a review of an earlier scan', 'stale-plan'), ('a file that isn''t there', 'not-indexed'), ('no token', 'no-token'), ('another token', 'stale-token'), ('another path', 'wrong-path'), ('a cue twice', 'bad-cues'),
  ('the open file', 'accepted'), ('the same token again', 'stale-token')) as t("case", outcome)""",
}
