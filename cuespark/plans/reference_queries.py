"""Queries over the data tables for the operators on cues, files, issues and documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuespark import functions as C
from cuespark.operators.native_srt import parse_srt_native
from cuespark.operators.parse import cues_of, issues_of, parse_files
from cuespark.operators.plan import cumulative_progress, marked_counts, marks_after_refresh, mutation_summary, outside_targets, plan_files, recovery_roles, request_size, retained_numbers, source_positions
from cuespark.operators.ranking import global_rank
from cuespark.operators.render import encode_file, render_files
from cuespark.operators.rewrite import render_deletion, splice_out
from cuespark.operators.search import dedupe_phrases, editor_filter, page, phrase_list, preview, search_any, search_one, search_summary, search_table
from cuespark.shared import snapshot
from cuespark.tables import load

PHRASE = "thanks for staying with this feed"


def once(cues: DataFrame) -> DataFrame:
    """Each cue once: the delivery with the smallest row id."""
    return cues.withColumn("__n", F.row_number().over(Window.partitionBy("path", "cue_id").orderBy("row_id"))).where("__n = 1").drop("__n")


def _cues(spark: SparkSession, directory: str) -> DataFrame:
    return once(load(spark, directory, "cues"))


def _files(spark: SparkSession, directory: str) -> DataFrame:
    """The latest scan of each file."""
    ranked = load(spark, directory, "scan_files").withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("revision"), F.desc("scanned_at"))))
    return ranked.where("__n = 1").drop("__n")


def _phrases(spark: SparkSession, directory: str) -> list[str]:
    return phrase_list(load(spark, directory, "phrases"), "query_index", "query")


def _plain(cues: DataFrame, form: Column | None = None) -> DataFrame:
    """Usable cues with a text that every format carries: letters, digits, blanks, after a mark."""
    text = F.concat(F.lit("x "), F.regexp_replace(F.coalesce("display_text", F.lit("")), r"[^\p{L}\p{Nd} ]", ""))
    return cues.where("end_ms > start_ms and start_ms >= 0").withColumn("plain", text).select("path", "ordinal", "start_ms", "end_ms", "plain")


def _whole(cues: DataFrame, form: Column) -> DataFrame:
    """Every cue that a file can hold, with its text as it is: line breaks are blanks, and a text that is null or blank is written as one that shows nothing."""
    text = F.regexp_replace(F.coalesce("display_text", F.lit("")), r"\r\n|\r|\n", " ")
    nothing = F.when(form == "ass", "").otherwise("<b></b>")
    rows = cues.where("end_ms >= start_ms and start_ms >= 0").withColumn("plain", F.when(C.is_blank(text), nothing).otherwise(text))
    return rows.select("path", "ordinal", "start_ms", "end_ms", "plain")


# text functions


def normalize_display(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "documents").where("text is not null").select("doc_id", C.normalize_display("text").alias("display"))


def normalize_search(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "documents").where("text is not null").select("doc_id", C.normalize_search("text").alias("search"))


def sanitize_text(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "cues").select("row_id", C.sanitize(F.col("display_text")).alias("shown"))


def shell_quote(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "scan_files").select("path", C.shell_quote(F.col("path")).alias("quoted")).distinct()


def format_timestamp(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "cues").select("row_id", C.format_timestamp(F.col("start_ms")).alias("start_text"), C.format_timestamp(F.col("end_ms")).alias("end_text"))


def parse_clock(spark: SparkSession, directory: str) -> DataFrame:
    shown = load(spark, directory, "cues").select("row_id", C.format_timestamp(F.col("start_ms"), ",").alias("srt"), C.format_timestamp(F.col("start_ms")).alias("vtt"))
    return shown.select("row_id", C.parse_clock(F.col("srt"), ",.").alias("srt_ms"), C.parse_clock(F.substring("vtt", 4, 9), ".", True).alias("short_ms"))


def detect_format(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "scan_files").select("path", C.detect_format(F.col("path")).alias("detected")).distinct()


def content_sha256(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "documents").where("text is not null").select("doc_id", C.content_digest(F.encode("text", "UTF-8")).alias("sha256"))


def line_split(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "documents").where("text is not null").select("doc_id", F.posexplode(C.line_array(F.col("text"))).alias("line_no", "line"))


def cue_ids(spark: SparkSession, directory: str) -> DataFrame:
    made = C.cue_id(F.split_part("cue_id", F.lit(":"), F.lit(1)), F.col("delete_span.start"), F.col("delete_span.end"), F.col("ordinal"))
    return load(spark, directory, "cues").select("row_id", made.alias("made"))


def path_order(spark: SparkSession, directory: str) -> DataFrame:
    paths = load(spark, directory, "scan_files").select("path").distinct()
    folded = global_rank(paths, [C.normalize_search("path"), F.col("path")], "folded_rank")
    return global_rank(folded, [F.lower("path"), F.col("path")], "lower_rank")


# search


def search_single(spark: SparkSession, directory: str) -> DataFrame:
    return search_one(load(spark, directory, "cues"), PHRASE).select("row_id", "path", "cue_id")


def search_any_phrases(spark: SparkSession, directory: str) -> DataFrame:
    found = search_any(load(spark, directory, "cues"), _phrases(spark, directory))
    return found.select("row_id", F.array_join(F.col("query_indexes").cast("array<string>"), ",").alias("indexes"), F.array_join("matched_phrases", "|").alias("spellings"))


def search_phrase_table(spark: SparkSession, directory: str) -> DataFrame:
    phrases = dedupe_phrases(load(spark, directory, "phrases"), "query_index", "query")
    found = search_table(load(spark, directory, "cues"), phrases, ["row_id"])
    return found.select("row_id", F.array_join(F.col("query_indexes").cast("array<string>"), ",").alias("indexes"))


def search_counts(spark: SparkSession, directory: str) -> DataFrame:
    found = search_any(_cues(spark, directory), _phrases(spark, directory))
    return search_summary(found, _files(spark, directory), load(spark, directory, "issues").select("path").distinct())


def matches_per_file(spark: SparkSession, directory: str) -> DataFrame:
    return search_any(_cues(spark, directory), _phrases(spark, directory)).groupBy("path").agg(F.count(F.lit(1)).alias("cues"))


def phrase_dedupe(spark: SparkSession, directory: str) -> DataFrame:
    raw = load(spark, directory, "json_cues").select("match_id", F.posexplode("matched_phrases").alias("i", "query")).where(F.col("query").rlike(r"^[\x20-\x7E]*\z"))
    return dedupe_phrases(raw.withColumn("o", F.col("match_id") * 1000 + F.col("i")), "o", "query")


def phrase_dedupe_all(spark: SparkSession, directory: str) -> DataFrame:
    """As ``phrase_dedupe``, over every matched phrase, whatever its letters."""
    raw = load(spark, directory, "json_cues").select("match_id", F.posexplode("matched_phrases").alias("i", "query"))
    return dedupe_phrases(raw.withColumn("o", F.struct("match_id", "i")), "o", "query")


def preview_top5(spark: SparkSession, directory: str) -> DataFrame:
    return preview(_cues(spark, directory)).select("path", "ordinal", "cue_id")


def match_projection(spark: SparkSession, directory: str) -> DataFrame:
    found = search_any(_cues(spark, directory), _phrases(spark, directory))
    return found.select("path", F.col("cue_id").alias("id"), "start_ms", "end_ms", F.col("display_text").alias("text"), F.array_join("matched_phrases", "|").alias("phrases"))


# scans and issues


def scan_projection(spark: SparkSession, directory: str) -> DataFrame:
    return _files(spark, directory).select("path", "format", "encoding", F.col("cue_count").alias("cues"), "size")


def cues_per_file(spark: SparkSession, directory: str) -> DataFrame:
    counted = _cues(spark, directory).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return _files(spark, directory).select("path").join(counted, "path", "left").select("path", F.coalesce("n", F.lit(0)).cast("bigint").alias("cues"))


def files_union_issues(spark: SparkSession, directory: str) -> DataFrame:
    files = _files(spark, directory).select("path", "size", F.lit("valid").alias("kind"))
    issues = load(spark, directory, "issues").groupBy("path", "kind").agg(F.max("size").alias("size"))
    return files.unionByName(issues)


def issue_counts(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, directory, "issues").groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("path").alias("files"))


def json_export(spark: SparkSession, directory: str) -> DataFrame:
    record = F.struct("path", "kind", "error")
    return load(spark, directory, "issues").select("path", C.escape_json(F.to_json(record)).alias("json"))


# plans and rewriting


def _deleted(spark: SparkSession, directory: str) -> DataFrame:
    return search_any(_cues(spark, directory), _phrases(spark, directory))


def plan_by_file(spark: SparkSession, directory: str) -> DataFrame:
    plan = plan_files(_deleted(spark, directory), _files(spark, directory), "all", 1)
    return plan.select("path", "expected_sha256", F.array_join("cue_ids", ",").alias("cue_ids"), "search_revision", "scope")


def plan_selected(spark: SparkSession, directory: str) -> DataFrame:
    files = _files(spark, directory)
    return plan_files(_deleted(spark, directory), files, "selected", 1, files.where("encoding = 'utf-8'")).select("path", F.size("cue_ids").cast("bigint").alias("cues"))


def retained_renumbered(spark: SparkSession, directory: str) -> DataFrame:
    return retained_numbers(_cues(spark, directory), _deleted(spark, directory), load(spark, directory, "cues"))


def status_summary(spark: SparkSession, directory: str) -> DataFrame:
    kinds = {"invalid": "failed", "too-large": "skipped", "symlink": "conflicted", "hardlink": "not-attempted", "unsafe": "restored"}
    status = F.lit("succeeded")
    for kind, to in kinds.items():
        status = F.when(F.col("kind") == kind, to).otherwise(status)
    results = load(spark, directory, "issues").select(status.alias("status"), F.coalesce("error_line", F.lit(0)).alias("deleted_cues"))
    return mutation_summary(results)


def recovery_role_list(spark: SparkSession, directory: str) -> DataFrame:
    issues = load(spark, directory, "issues").where("path is not null").groupBy("path").agg(F.max("kind").alias("kind"))
    manifests = issues.where("kind <> 'unreadable'").select(F.col("path").alias("id"), (F.col("kind") == "unsafe").alias("corrupt"))
    role = F.when(F.col("kind") == "symlink", "undo").when(F.col("kind") == "hardlink", "pending").when(F.col("kind") == "too-large", "garbage").when(F.col("kind") == "unreadable", "pending")
    return recovery_roles(manifests, issues.select(F.col("path").alias("id"), role.alias("role")).where("role is not null"))


def marks_per_file(spark: SparkSession, directory: str) -> DataFrame:
    cues = _cues(spark, directory)
    return marked_counts(cues, cues.where("ordinal % 2 = 0"), search_any(cues, ["the", "la"]))


def marks_kept(spark: SparkSession, directory: str) -> DataFrame:
    """Every second cue is marked; a later scan has only the cues with usable times."""
    cues = _cues(spark, directory)
    return marks_after_refresh(cues.where("ordinal % 2 = 0").select("path", "cue_id"), cues.where("end_ms > start_ms"))


def editor_positions(spark: SparkSession, directory: str) -> DataFrame:
    visible = editor_filter(load(spark, directory, "cues"), "the").select("path", "cue_id")
    return source_positions(visible, _cues(spark, directory)).select("path", "cue_id", "ordinal", "unknown")


def editor_page(spark: SparkSession, directory: str) -> DataFrame:
    cues = _cues(spark, directory).where("path like '%open-feed%'")
    return page(cues, 3, 20).select("ordinal", "cue_id")


def targets_outside(spark: SparkSession, directory: str) -> DataFrame:
    return outside_targets(_cues(spark, directory), _files(spark, directory).where("encoding = 'utf-8'"))


def request_counts(spark: SparkSession, directory: str) -> DataFrame:
    return request_size(plan_files(_deleted(spark, directory), _files(spark, directory), "all", 1))


def progress_sums(spark: SparkSession, directory: str) -> DataFrame:
    """The issues of the export as results of one change, in the order of path and kind."""
    results = load(spark, directory, "issues").groupBy("path", "kind").agg(F.coalesce(F.max("error_line"), F.lit(0)).alias("deleted_cues"))
    return cumulative_progress(results.withColumn("position", F.struct("path", "kind")))


# files made from cues, and read again

Prepare = Callable[[DataFrame, Column], DataFrame]


def _rendered(form: str, prepare: Prepare = _plain):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return render_files(prepare(_cues(spark, directory), F.lit(form)), form, "plain", bound=load(spark, directory, "cues")).select("path", F.sha2("body", 256).alias("sha256"), F.length("body").cast("bigint").alias("chars"))

    return query


def _read_again(form: str, encoding: str = "utf-8", prepare: Prepare = _plain):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        files = render_files(prepare(_cues(spark, directory), F.lit(form)), form, "plain", bound=load(spark, directory, "cues")).select("path", encode_file(F.col("body"), encoding).alias("content"))
        parsed = parse_files(files, form=F.lit(form))
        return cues_of(parsed).select("path", "ordinal", "start_ms", "end_ms", "display_text", "search_text")

    return query


def roundtrip_srt_native(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    files = render_files(prepare(_cues(spark, directory), F.lit("srt")), "srt", "plain", bound=load(spark, directory, "cues")).select("path", encode_file(F.col("body"), "utf-8").alias("content"))
    return parse_srt_native(files).select("path", "ordinal", "start_ms", "end_ms", "display_text", "search_text")


def cue_spans(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    files = render_files(prepare(_cues(spark, directory), F.lit("srt")), "srt", "plain", bound=load(spark, directory, "cues")).select("path", encode_file(F.col("body"), "utf-8").alias("content"))
    cues = cues_of(parse_files(files, form=F.lit("srt")))
    return cues.select("path", "ordinal", "cue_id", F.col("delete_span.start").alias("first"), F.col("delete_span.end").alias("last"), (F.col("index_span.end") - F.col("index_span.start")).alias("digits"))


def _made(spark: SparkSession, directory: str, form: str, prepare: Prepare = _plain) -> tuple[DataFrame, DataFrame]:
    """Files with their bytes, and the plan that deletes every third cue."""
    files = render_files(prepare(_cues(spark, directory), F.lit(form)), form, "plain", bound=load(spark, directory, "cues")).select("path", F.lit(form).alias("format"), encode_file(F.col("body"), "utf-8").alias("content"))
    files = snapshot(files)  # read for the plan and for the deletion
    cues = cues_of(parse_files(files, form=F.lit(form)))
    plan = cues.where("ordinal % 3 = 1").groupBy("path").agg(F.array_sort(F.collect_list("cue_id")).alias("cue_ids"))
    return files, plan


def delete_render_srt(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    return render_deletion(*_made(spark, directory, "srt", prepare)).select("path", "post_sha256", "deleted_cues", "valid")


def delete_native_vtt(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    files = snapshot(render_files(prepare(_cues(spark, directory), F.lit("webvtt")), "webvtt", "plain", bound=load(spark, directory, "cues")).select("path", encode_file(F.col("body"), "utf-8").alias("content")))
    parsed = parse_files(files, form=F.lit("webvtt")).select("path", F.transform(F.filter("cues", lambda c: c["ordinal"] % 3 == 1), lambda c: c["delete_span"]).alias("spans"))
    return files.join(parsed, "path").select("path", F.sha2(splice_out(F.col("content"), F.col("spans")), 256).alias("sha256"))


def delete_nothing(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    files, plan = _made(spark, directory, "srt", prepare)
    none = plan.withColumn("cue_ids", F.array().cast("array<string>"))
    return render_deletion(files, none).select("path", "post_sha256", "changed", "valid")


def malformed_issues(spark: SparkSession, directory: str, prepare: Prepare = _plain) -> DataFrame:
    files = render_files(prepare(_cues(spark, directory), F.lit("srt")), "srt", "plain", bound=load(spark, directory, "cues"))
    # the timing line of the first cue is broken in files whose path has an even length
    broken = F.when(F.length("path") % 2 == 0, F.regexp_replace("body", r"^1\n([^\n]*) --> ", "1\n$1 -> ")).otherwise(F.col("body"))
    parsed = parse_files(files.select("path", encode_file(broken, "utf-8").alias("content")), form=F.lit("srt"))
    return issues_of(parsed).select("path", "kind", F.col("error_line").cast("int").alias("error_line"), "error")


def documents_parsed(spark: SparkSession, directory: str) -> DataFrame:
    """The cues of every document that is a subtitle file; one without cues is one row, with its error if it has one."""
    files = load(spark, directory, "documents").where("format in ('srt', 'webvtt')").select(F.col("doc_id").cast("string").alias("path"), "format", F.encode("text", "UTF-8").alias("content"))
    parsed = parse_files(files, form=F.col("format"))
    cues = parsed.select(F.col("path").cast("bigint").alias("doc_id"), "format", F.explode_outer("cues").alias("cue"), "error_line", "error")
    return cues.select("doc_id", "format", "cue.ordinal", "cue.start_ms", "cue.end_ms", "cue.display_text", "cue.search_text", "error_line", "error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_display, normalize_search, sanitize_text, shell_quote, format_timestamp, parse_clock, detect_format, content_sha256, line_split, cue_ids, path_order,
        search_single, search_any_phrases, search_phrase_table, search_counts, matches_per_file, phrase_dedupe, phrase_dedupe_all, preview_top5, match_projection,
        scan_projection, cues_per_file, files_union_issues, issue_counts, json_export,
        plan_by_file, plan_selected, retained_renumbered, status_summary, recovery_role_list,
        marks_per_file, marks_kept, editor_positions, editor_page, targets_outside, request_counts, progress_sums,
        cue_spans, delete_render_srt, delete_native_vtt, delete_nothing, malformed_issues, documents_parsed,
    )
} | {
    "render_srt": _rendered("srt"), "render_vtt": _rendered("webvtt"), "render_ass": _rendered("ass"),
    "roundtrip_srt_native": roundtrip_srt_native, "roundtrip_srt": _read_again("srt"), "roundtrip_vtt": _read_again("webvtt"), "roundtrip_ass": _read_again("ass"),
    "roundtrip_utf16": _read_again("srt", "utf-16le-bom"), "roundtrip_utf16be_ass": _read_again("ass", "utf-16be-bom"),
} | {
    "whole_render_srt": _rendered("srt", _whole), "whole_render_vtt": _rendered("webvtt", _whole), "whole_render_ass": _rendered("ass", _whole),
    "whole_roundtrip_srt": _read_again("srt", prepare=_whole), "whole_roundtrip_vtt": _read_again("webvtt", prepare=_whole), "whole_roundtrip_ass": _read_again("ass", prepare=_whole),
    "whole_roundtrip_utf16": _read_again("srt", "utf-16le-bom", _whole), "whole_roundtrip_utf16be_ass": _read_again("ass", "utf-16be-bom", _whole),
} | {f"whole_{f.__name__}": functools.partial(f, prepare=_whole) for f in (roundtrip_srt_native, cue_spans, delete_render_srt, delete_native_vtt, delete_nothing, malformed_issues)}

_WHITE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ONCE = "once as (select * from cues qualify row_number() over (partition by path, cue_id order by row_id) = 1)"
_LATEST = "latest as (select * from scan_files qualify row_number() over (partition by path order by revision desc, scanned_at desc) = 1)"
_HITS = "hits as (select c.row_id, p.query_index, p.query from cues c join phrases p on contains(c.search_text, p.query))"
_FOUND = f"{_ONCE}, found as (select distinct o.* from once o join phrases p on contains(o.search_text, p.query))"


def _clock(ms: str, separator: str = ".") -> str:
    t = f"greatest({ms}, 0)"
    return f"case when {ms} is not null then printf('%02d:%02d:%02d{separator}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000) end"


_PLAIN = rf"""{_ONCE}, plain as (select path, ordinal, start_ms, end_ms, 'x ' || regexp_replace(coalesce(display_text, ''), '[^\p{{L}}\p{{Nd}} ]', '', 'g') as plain,
  row_number() over (partition by path order by ordinal) as n from once where end_ms > start_ms and start_ms >= 0)"""
_SRT = f"n || chr(10) || {_clock('start_ms', ',')} || ' --> ' || {_clock('end_ms', ',')} || chr(10) || plain || chr(10) || chr(10)"
_VTT = f"{_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(10) || plain || chr(10) || chr(10)"
_ASS = f"'Dialogue: 0,' || {_clock('start_ms')} || ',' || {_clock('end_ms')} || ',Default,' || plain || chr(10)"
_VTT_HEAD = "'WEBVTT' || chr(10) || chr(10)"
_ASS_HEAD = "array_to_string(['[Script Info]', 'ScriptType: v4.00+', '', '[Events]', 'Format: Layer, Start, End, Style, Text', ''], chr(10))"


def _bodies(block: str, head: str = "''") -> str:
    return f"{_PLAIN}, bodies as (select path, {head} || string_agg({block}, '' order by ordinal) as body from plain group by path)"


def _render_sql(block: str, head: str = "''") -> str:
    return f"with {_bodies(block, head)} select path, sha256(body) as sha256, cast(length(body) as bigint) as chars from bodies"


_FOLD = "replace(replace(lower({}), 'ß', 'ss'), 'µ', 'μ')"  # the micro sign folds to the letter mu
_AGAIN = rf"""with {_PLAIN} select path, cast(n - 1 as int) as ordinal, start_ms, end_ms, trim(regexp_replace(nfc_normalize(plain), ' +', ' ', 'g')) as display_text,
  {_FOLD.format("trim(regexp_replace(nfc_normalize(plain), ' +', ' ', 'g'))")} as search_text from plain"""

ORACLES: dict[str, str] = {
    "normalize_display": rf"select doc_id, trim(regexp_replace(nfc_normalize(text), '{_WHITE}', ' ', 'g')) as display from documents where text is not null",
    "normalize_search": rf"select doc_id, {_FOLD.format(f"trim(regexp_replace(nfc_normalize(text), '{_WHITE}', ' ', 'g'))")} as search from documents where text is not null",
    "sanitize_text": r"""select row_id, regexp_replace(display_text, '[\x00-\x1F\x7F-\x{9F}\x{61C}\x{200E}\x{200F}\x{2028}-\x{202E}\x{2066}-\x{206F}]', '�', 'g') as shown from cues""",
    "shell_quote": "select distinct path, '''' || replace(path, '''', '''\\''''') || '''' as quoted from scan_files",
    "format_timestamp": f"select row_id, {_clock('start_ms')} as start_text, {_clock('end_ms')} as end_text from cues",
    "parse_clock": "select row_id, case when start_ms is not null then greatest(start_ms, 0) end as srt_ms, case when start_ms < 360000000 then greatest(start_ms, 0) % 3600000 end as short_ms from cues",
    "detect_format": "select distinct path, case lower(regexp_extract(path, '\\.[^./]*$')) when '.srt' then 'srt' when '.ass' then 'ass' when '.vtt' then 'webvtt' end as detected from scan_files",
    "content_sha256": "select doc_id, sha256(text) as sha256 from documents where text is not null",
    "line_split": r"""with split as (select doc_id, string_split_regex(text, '\r\n|\r|\n') as l from documents where text is not null),
cut as (select doc_id, case when l[len(l)] = '' then l[1:len(l) - 1] else l end as l from split)
select doc_id, cast(unnest(range(0, len(l))) as int) as line_no, unnest(l) as line from cut""",
    "cue_ids": "select row_id, split_part(cue_id, ':', 1) || ':' || delete_span.start || ':' || delete_span.end || ':' || ordinal as made from cues",
    "path_order": """with p as (select distinct path from scan_files)
select path, row_number() over (order by lower(path), path) as folded_rank, row_number() over (order by lower(path), path) as lower_rank from p""",
    "search_single": f"select row_id, path, cue_id from cues where contains(search_text, '{PHRASE}')",
    "search_any_phrases": f"with {_HITS} select row_id, string_agg(query_index, ',' order by query_index) as indexes, string_agg(query, '|' order by query_index) as spellings from hits group by row_id",
    "search_phrase_table": f"with {_HITS} select row_id, string_agg(query_index, ',' order by query_index) as indexes from hits group by row_id",
    "search_counts": f"""with {_FOUND} select count(*) as matching_cues, count(distinct path) as matching_files,
  (select count(distinct path) from scan_files) as scanned_files, (select count(distinct path) from issues) as skipped_files from found""",
    "matches_per_file": f"with {_FOUND} select path, count(*) as cues from found group by path",
    "phrase_dedupe": r"""with raw as (select match_id * 1000 + i as o, matched_phrases[i + 1] as query from (select match_id, matched_phrases, unnest(range(0, len(matched_phrases))) as i from json_cues)),
formed as (select o, query, trim(regexp_replace(lower(query), ' +', ' ', 'g')) as normalized from raw where regexp_full_match(query, '[\x20-\x7E]*')),
firsts as (select * from formed where normalized <> '' qualify row_number() over (partition by normalized order by o, query) = 1)
select cast(row_number() over (order by o, query) - 1 as int) as query_index, query, normalized from firsts""",
    "phrase_dedupe_all": rf"""with raw as (select match_id, i, matched_phrases[i + 1] as query from (select match_id, matched_phrases, unnest(range(0, len(matched_phrases))) as i from json_cues)),
formed as (select match_id, i, query, {_FOLD.format(f"trim(regexp_replace(nfc_normalize(query), '{_WHITE}', ' ', 'g'))")} as normalized from raw),
firsts as (select * from formed where normalized <> '' qualify row_number() over (partition by normalized order by match_id, i, query) = 1)
select cast(row_number() over (order by match_id, i, query) - 1 as int) as query_index, query, normalized from firsts""",
    "preview_top5": f"with {_ONCE} select path, ordinal, cue_id from once qualify row_number() over (partition by path order by ordinal) <= 5",
    "match_projection": f"""with {_ONCE} select path, cue_id as id, start_ms, end_ms, display_text as text, string_agg(query, '|' order by query_index) as phrases
  from once join phrases on contains(search_text, query) group by path, cue_id, start_ms, end_ms, display_text""",
    "scan_projection": f"with {_LATEST} select path, format, encoding, cue_count as cues, size from latest",
    "cues_per_file": f"with {_ONCE}, {_LATEST} select l.path, count(o.row_id) as cues from latest l left join once o on l.path = o.path group by l.path",
    "files_union_issues": f"with {_LATEST} select path, size, 'valid' as kind from latest union all select path, max(size) as size, kind from issues group by path, kind",
    "issue_counts": "select kind, count(*) as rows, count(distinct path) as files from issues group by kind",
    "json_export": """select path, '{"path":' || to_json(path) || ',"kind":' || to_json(kind) || case when error is not null then ',"error":' || to_json(error) else '' end || '}' as json from issues""",
    "plan_by_file": f"""with {_FOUND}, {_LATEST} select l.path, sha256 as expected_sha256, string_agg(cue_id, ',' order by ordinal) as cue_ids, cast(1 as bigint) as search_revision, 'all' as scope
  from found f join latest l on f.path = l.path group by l.path, sha256""",
    "plan_selected": f"with {_FOUND}, {_LATEST} select l.path, count(*) as cues from found f join latest l on f.path = l.path where l.encoding = 'utf-8' group by l.path",
    "retained_renumbered": f"""with {_FOUND} select path, cue_id, cast(row_number() over (partition by path order by ordinal) as int) as number from once where row_id not in (select row_id from found)""",
    "status_summary": """select count(*) filter (kind = 'unreadable') as succeeded, count(*) filter (kind = 'unsafe') as restored, count(*) filter (kind = 'too-large') as skipped,
  count(*) filter (kind = 'symlink') as conflicted, count(*) filter (kind = 'invalid') as failed, count(*) filter (kind = 'hardlink') as not_attempted, cast(sum(coalesce(error_line, 0)) as bigint) as deleted_cues from issues""",
    "recovery_role_list": """select path as id, case max(kind) when 'symlink' then 'undo' when 'hardlink' then 'pending' when 'too-large' then 'garbage' when 'unreadable' then 'corrupt' when 'unsafe' then 'corrupt' else 'orphan' end as role
  from issues where path is not null group by path""",
    "marks_per_file": f"""with {_ONCE}, marked as (select *, coalesce(contains(search_text, 'the') or contains(search_text, 'la'), false) as shown from once where ordinal % 2 = 0)
select path, count(*) as marked, count(*) filter (shown) as visible_marked, count(*) filter (not shown) as hidden_marked from marked group by path""",
    "marks_kept": f"with {_ONCE} select path, cue_id from once where ordinal % 2 = 0 and end_ms > start_ms",
    "editor_positions": f"with {_ONCE} select path, cue_id, ordinal, false as unknown from once where contains(search_text, 'the')",
    "editor_page": f"with {_ONCE} select ordinal, cue_id from once where path like '%open-feed%' order by ordinal limit 20 offset 60",
    "targets_outside": f"with {_LATEST} select distinct path from cues where path is not null and path not in (select path from latest where encoding = 'utf-8')",
    "request_counts": f"with {_FOUND}, {_LATEST} select count(distinct f.path) as files, count(*) as cues from found f join latest l on f.path = l.path",
    "progress_sums": """with r as (select path, kind, coalesce(max(error_line), 0) as d from issues group by path, kind)
select path, count(*) over w as completed, cast(sum(d) over w as bigint) as deleted_so_far from r window w as (order by path, kind rows unbounded preceding)""",
    "render_srt": _render_sql(_SRT),
    "render_vtt": _render_sql(_VTT, _VTT_HEAD),
    "render_ass": _render_sql(_ASS, _ASS_HEAD),
    "roundtrip_srt_native": _AGAIN, "roundtrip_srt": _AGAIN, "roundtrip_vtt": _AGAIN, "roundtrip_ass": _AGAIN, "roundtrip_utf16": _AGAIN, "roundtrip_utf16be_ass": _AGAIN,
    "cue_spans": f"""with {_PLAIN}, sized as (select path, n, strlen({_SRT}) as size from plain),
placed as (select path, n, sum(size) over (partition by path order by n) as last, size from sized)
select path, cast(n - 1 as int) as ordinal, 'srt:' || cast(last - size as bigint) || ':' || cast(last as bigint) || ':' || (n - 1) as cue_id, cast(last - size as bigint) as first, cast(last as bigint) as last, cast(length(n::varchar) as bigint) as digits from placed""",
    "delete_render_srt": f"""with {_PLAIN}, kept as (select path, ordinal, start_ms, end_ms, plain, row_number() over (partition by path order by ordinal) as n from plain where (n - 1) % 3 <> 1),
bodies as (select path, string_agg({_SRT}, '' order by ordinal) as body from kept group by path),
counts as (select path, count(*) filter ((n - 1) % 3 = 1) as gone from plain group by path)
select path, sha256(body) as post_sha256, cast(gone as int) as deleted_cues, true as valid from bodies join counts using (path) where gone > 0""",
    "delete_native_vtt": f"""with {_PLAIN}, bodies as (select path, {_VTT_HEAD} || coalesce(string_agg({_VTT}, '' order by ordinal) filter ((n - 1) % 3 <> 1), '') as body from plain group by path)
select path, sha256(body) as sha256 from bodies""",
    "delete_nothing": f"with {_bodies(_SRT)} select path, sha256(body) as post_sha256, false as changed, true as valid from bodies where path in (select path from plain where n = 2)",
    "malformed_issues": f"with {_PLAIN} select distinct path, 'invalid' as kind, 2 as error_line, path || ':2: invalid SRT timing line' as error from plain where length(path) % 2 = 0",
}


def _whole_sql(nothing: str) -> str:
    """As ``_PLAIN``, with every cue that a file can hold and its text as it is; ``nothing`` stands for a blank one."""
    return rf"""{_ONCE}, lines as (select *, regexp_replace(coalesce(display_text, ''), '\r\n|\r|\n', ' ', 'g') as line from once where end_ms >= start_ms and start_ms >= 0),
plain as (select path, ordinal, start_ms, end_ms, case when trim(regexp_replace(line, '{_WHITE}', ' ', 'g')) = '' then {nothing} else line end as plain,
  row_number() over (partition by path order by ordinal) as n from lines)"""


_TAGS_ONLY = "'<b></b>'"
_WHOLE_DISPLAY = f"trim(regexp_replace(nfc_normalize(plain), '{_WHITE}', ' ', 'g'))"
_WHOLE_AGAIN = f"""with {_whole_sql("''")} select path, cast(n - 1 as int) as ordinal, start_ms, end_ms, {_WHOLE_DISPLAY} as display_text, {_FOLD.format(_WHOLE_DISPLAY)} as search_text from plain"""

ORACLES |= {
    f"whole_{name}": ORACLES[name].replace(_PLAIN, _whole_sql("''" if name == "render_ass" else _TAGS_ONLY))
    for name in ("render_srt", "render_vtt", "render_ass", "cue_spans", "delete_render_srt", "delete_native_vtt", "delete_nothing", "malformed_issues")
} | {f"whole_{name}": _WHOLE_AGAIN for name in ("roundtrip_srt_native", "roundtrip_srt", "roundtrip_vtt", "roundtrip_ass", "roundtrip_utf16", "roundtrip_utf16be_ass")}
