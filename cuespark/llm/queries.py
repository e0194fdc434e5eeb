"""Queries p2_, p3_, p5_ to p9_, with their SQL counterparts."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.llm.encodings import find_garbled, repair_garbled
from cuespark.llm.leaks import LEAST_WORDS, leaked_passages
from cuespark.llm.lookalike import canonical_form, find_lookalikes, phrase_blocks, skeletons, unify
from cuespark.llm.mixing import mix, mix_report, mix_sized, report_sized
from cuespark.llm.quality import collect_common_words, text_statistics
from cuespark.llm.runs import collapse_runs
from cuespark.llm.site_lines import mark_repeated, remove_repeated, repeated_lines
from cuespark.tables import load


def _site():
    """The first component of a path."""
    return F.split_part(F.col("path"), F.lit("/"), F.lit(1))


def _runs(spark: SparkSession, directory: str) -> DataFrame:
    return collapse_runs(load(spark, directory, "cues"), "path", "cue_id", "ordinal", "start_ms", "end_ms", "display_text")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return _runs(spark, directory).where(F.col("count") >= 2).select("path", "first_ordinal", "last_ordinal")


def p2_collapsed(spark: SparkSession, directory: str) -> DataFrame:
    return _runs(spark, directory)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return find_garbled(load(spark, directory, "cues"), "row_id", _site(), ["display_text"]).select("row_id")


def p3_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return repair_garbled(load(spark, directory, "cues"), "row_id", _site(), ["display_text"])


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    parts = [("cues", "row_id", "search_text", False), ("json_cues", "match_id", "matched_phrases", True)]
    found = None
    for phrases in phrase_blocks(load(spark, directory, "phrases"), "query_index", "query"):
        for name, key, text, whole in parts:
            rows = find_lookalikes(load(spark, directory, name), key, text, phrases, whole).select(F.lit(name).alias("table_name"), "record_id", "query_index")
            found = rows if found is None else found.unionAll(rows)
    return found


def p5_unified(spark: SparkSession, directory: str) -> DataFrame:
    """Every text of problem 5; ``position`` is the place in matched_phrases, null for cues."""
    forms = ["unified", "unified_look", "unified_capitals"]
    cues = unify(load(spark, directory, "cues").select("row_id", "search_text"), "search_text")
    phrases = unify(load(spark, directory, "json_cues").select("match_id", "matched_phrases").where(F.size("matched_phrases") > 0), "matched_phrases")
    phrases = phrases.select("match_id", F.posexplode(F.arrays_zip(*forms)).alias("position", "form"))
    return cues.select(F.lit("cues").alias("table_name"), F.col("row_id").alias("record_id"), F.lit(None).cast("int").alias("position"), *forms).unionAll(
        phrases.select(F.lit("json_cues").alias("table_name"), F.col("match_id").alias("record_id"), "position", *[f"form.{n}" for n in forms])
    )


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return mark_repeated(load(spark, directory, "json_cues").select("match_id", "path", "text"), _site(), "path", "text").select("match_id")


def p6_lines(spark: SparkSession, directory: str) -> DataFrame:
    lines = repeated_lines(load(spark, directory, "json_cues").select("path", "text"), _site(), "path", "text").lines
    return lines.groupBy("source", "key").agg(F.max("documents").cast("bigint").alias("documents"), F.max("files").cast("bigint").alias("files"))


def p6_cleaned(spark: SparkSession, directory: str) -> DataFrame:
    return remove_repeated(load(spark, directory, "json_cues").select("match_id", "path", "id", "text"), _site(), "path", "text")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return p7_passages(spark, directory).where(F.col("run") >= LEAST_WORDS).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, directory: str) -> DataFrame:
    return leaked_passages(load(spark, directory, "documents"), "doc_id", "text", "format", load(spark, directory, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return p8_shares(spark, directory).where("short").select("source")


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mix(load(spark, directory, "documents"), "doc_id", "text", load(spark, directory, "mix_targets"))


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mix_report(load(spark, directory, "documents"), "doc_id", "text", load(spark, directory, "mix_targets"))


def _characters(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with their length in characters for size, which SQL can count too."""
    return load(spark, directory, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("tokens"))


def p8_mix_characters(spark: SparkSession, directory: str) -> DataFrame:
    return mix_sized(_characters(spark, directory), load(spark, directory, "mix_targets"))


def p8_shares_characters(spark: SparkSession, directory: str) -> DataFrame:
    return report_sized(_characters(spark, directory), load(spark, directory, "mix_targets"))


def _statistics(spark: SparkSession, directory: str) -> DataFrame:
    common = collect_common_words(load(spark, directory, "common_words"))
    return text_statistics(load(spark, directory, "documents"), "doc_id", "text", "lang", "format", common)


def p9_chunked(spark: SparkSession, directory: str) -> DataFrame:
    """The same statistics in chunks of 1,024 bytes: nearly every document is counted in parts that are merged."""
    common = collect_common_words(load(spark, directory, "common_words"))
    return text_statistics(load(spark, directory, "documents"), "doc_id", "text", "lang", "format", common, chunk=1_024).drop("broken")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return _statistics(spark, directory).where(F.size("broken") > 0).select("doc_id")


def p9_statistics(spark: SparkSession, directory: str) -> DataFrame:
    return _statistics(spark, directory).drop("broken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p2_found, p2_collapsed, p3_found, p3_repaired, p5_found, p5_unified, p6_found, p6_lines, p6_cleaned, p7_found, p7_passages,
        p8_found, p8_mix, p8_shares, p8_mix_characters, p8_shares_characters, p9_found, p9_statistics, p9_chunked,
    )
}

_SITE_LINES = r"""
texts as (select match_id, path, id, text, split_part(path, '/', 1) as source, nullif(regexp_replace(lower(text), '[^\p{L}]', '', 'g'), '') as key from json_cues),
sizes as (select source, count(distinct path) as files from texts where path is not null group by source),
repeated as (select t.source, t.key, count(distinct path) as documents, max(files) as files from texts t join sizes s on t.source = s.source
  where key is not null and path is not null group by t.source, t.key having count(distinct path) >= 3 and count(distinct path) * 5 >= max(files))
"""
_FOUND6 = "select match_id from texts t join repeated r on t.source = r.source and t.key = r.key"

# the edit distance is a fold over the characters of one text of a fold over those of the other
_RUNS = r"""
usable as (select distinct path, cue_id, ordinal, start_ms, end_ms, regexp_replace(lower(display_text), '[^\p{L}\p{N}]', '', 'g') as x from cues where end_ms > start_ms and path is not null),
linked as (select *, lag(x) over w as px, lag(end_ms) over w as pt, row_number() over w as n from usable window w as (partition by path order by start_ms, ordinal, end_ms, x)),
close as (select *, start_ms - pt <= 10000 as soon, x = px as same,
  abs(length(x) - length(px)) * 10 <= greatest(length(x), length(px)) and regexp_replace(x, '\P{N}', '', 'g') = regexp_replace(px, '\P{N}', '', 'g') as maybe from linked),
pairs as (select distinct x, px from close where soon and maybe and not same),
lists as (select x, px, list_transform(string_split(x, ''), lambda c: [cast(ord(c) as bigint)]) as a, list_transform(string_split(px, ''), lambda c: cast(ord(c) as bigint)) as b from pairs),
distances as (select x, px, list_reduce(list_prepend(range(0, len(b) + 1), a),
  lambda r, ch: list_reduce(list_prepend([r[1] + 1], list_transform(range(1, len(b) + 1), lambda j: [j])),
    lambda acc, e: list_append(acc, least(r[e[1] + 1] + 1, acc[e[1]] + 1, r[e[1]] + case when b[e[1]] = ch[1] then 0 else 1 end))))[-1] as d from lists),
joined as (select c.*, coalesce(soon and (same or (maybe and d.d * 10 <= greatest(length(c.x), length(c.px)))), false) as goes_on from close c left join distances d on c.x = d.x and c.px = d.px),
runs as (select *, sum(case when goes_on then 0 else 1 end) over (partition by path order by n rows unbounded preceding) as run from joined)
"""

_SPOKEN = r"""
raw_lines as (select doc_id, format, lang, coalesce(format in ('srt', 'webvtt'), false) as timed, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n
  from documents where text is not null),
cut_lines as (select doc_id, lang, n, trim(case when timed then regexp_replace(line, '<[^>]*>', '', 'g') else line end, chr(9) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(12288)) as line
  from raw_lines where not timed or not ((n = 1 and starts_with(line, 'WEBVTT')) or contains(line, '-->') or regexp_full_match(line, '\s*[0-9]+\s*'))),
spoken as (select doc_id, lang, n, line from cut_lines where line <> '')
"""
_WORDS = rf"""{_SPOKEN},
doc_words as (select doc_id, list_filter(regexp_extract_all(lower(string_agg(line, ' ' order by n)), '[\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from spoken group by doc_id),
item_words as (select item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w from eval_items)
"""
_STATISTICS = rf"""{_SPOKEN},
tokens as (select doc_id, lang, n, line, list_filter(regexp_split_to_array(line, '[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '') as words from spoken),
vocabulary as (select lang, list(distinct word) as known from common_words group by lang),
every as (select list(distinct word) as known from common_words),
per_line as (select t.doc_id, len(words) as tokens, length(array_to_string(words, '')) as token_chars,
    length(regexp_replace(array_to_string(words, ''), '[\p{{L}}\p{{N}}]', '', 'g')) as symbols,
    case when regexp_matches(line, '[.!?…]$') then 1 else 0 end as ended,
    len(list_filter(words, lambda w: list_contains(case when t.lang is null then every.known else coalesce(v.known, []) end,
      replace(regexp_replace(regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''), '’', '''')))) as common
  from tokens t left join vocabulary v on t.lang = v.lang cross join every),
statistics as (select d.doc_id, cast(coalesce(sum(tokens), 0) as bigint) as tokens, cast(coalesce(sum(token_chars), 0) as bigint) as token_chars, cast(coalesce(sum(symbols), 0) as bigint) as symbols,
    cast(count(p.doc_id) as bigint) as lines, cast(coalesce(sum(ended), 0) as bigint) as ended, cast(coalesce(sum(common), 0) as bigint) as common
  from documents d left join per_line p on d.doc_id = p.doc_id where d.text is not null group by d.doc_id),
ratios as (select *, token_chars / nullif(tokens, 0) as mean_length, symbols / nullif(token_chars, 0) as symbol_share,
    ended / nullif(lines, 0) as ended_share, common / nullif(tokens, 0) as common_share from statistics)
"""

# expected copies are summed up along the MD5 of the ids, in units of 2^-32 copies, from an offset by the MD5 of the source
_MIX = """
sized as (select doc_id, source, coalesce(length(text), 0) as tokens from documents),
sizes as (select t.source, t.target_share, t.max_repeats, coalesce(sum(d.tokens), 0) as size from mix_targets t left join sized d on t.source = d.source group by all),
plan as (select *, cast(size as double) * max_repeats as most, target_share * cast(sum(size) over () as double) as wanted from sizes),
rated as (select d.*, round(least(p.wanted, p.most) / p.size * 4294967296.0)::hugeint as units, ('0x' || substr(md5(d.doc_id || ':42'), 1, 15))::bigint as place,
    ('0x' || substr(md5(d.source || ':42'), 1, 8))::hugeint as offset_ from sized d join plan p on d.source = p.source where p.size > 0),
summed as (select *, sum(units) over (partition by source order by place, source, doc_id, tokens rows unbounded preceding) + offset_ as upto from rated),
mix as (select doc_id, source, tokens, ((upto // 4294967296) - ((upto - units) // 4294967296))::bigint as copies from summed)
"""

# Forms in SQL: every character by its own form, then composed. Characters whose form has several are replaced first, one by one.
_PLACES = [*range(0x09, 0x0E), *range(0x1C, 0x20), *range(0x41, 0x5B), *range(0x85, 0x86), *range(0xA0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10300, 0x10500), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F270), *range(0x2F800, 0x2FA20)]
_FORMS = {"form": canonical_form, "look": lambda x: skeletons(x)[0], "capitals": lambda x: skeletons(x)[1]}


@functools.cache
def _form_sql(kind: str) -> tuple[str, str, str]:
    """(list of expanding characters, each with its form; characters; their forms) as SQL literals."""
    forms = {chr(c): _FORMS[kind](f"q{chr(c)}é")[1:-1] for c in _PLACES}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    expanded = ", ".join(quoted(c + x) for c, x in forms.items() if len(x) > 1 and unicodedata.normalize("NFC", c) == c)
    same = [(c, x) for c, x in forms.items() if len(x) == 1 and x != c]
    gone = "".join(c for c, x in forms.items() if not x)
    return f"[{expanded}]", quoted("".join(c for c, _ in same) + gone), quoted("".join(x for _, x in same))


def _formed(column: str, kind: str) -> str:
    expanded, before, after = _form_sql(kind)
    whole = f"list_reduce(list_prepend({column}, list_filter({expanded}, lambda e: contains({column}, e[1]))), lambda done, e: replace(done, e[1], e[2:]))"
    return f"trim(regexp_replace(nfc_normalize(translate(case when regexp_full_match({column}, '[\\x00-\\x7F]*') then {column} else {whole} end, {before}, {after})), '\\s+', ' ', 'g'))"


def _looks_sql() -> str:
    looks = lambda column: f"{_formed(column, 'look')} as look, {_formed(column, 'capitals')} as capitals, lower({column}) as low"
    return f"""with listed as (select query_index, {looks("query")} from phrases where trim(query) <> ''),
texts as (select 'cues' as table_name, row_id as record_id, search_text as x from cues where search_text is not null union all
  select 'json_cues', match_id, unnest(matched_phrases) from json_cues),
looked as (select table_name, record_id, {looks("x")} from texts where x is not null)
select distinct table_name, record_id, query_index from looked t join listed p on
  case when table_name = 'cues' then (contains(t.look, p.look) or contains(t.capitals, p.capitals)) and not contains(t.low, p.low)
  else (t.look = p.look or t.capitals = p.capitals) and t.low <> p.low end"""


def _unified_sql() -> str:
    return f"""with texts as (select 'cues' as table_name, row_id as record_id, cast(null as int) as position, search_text as x from cues union all
  select 'json_cues', match_id, cast(unnest(range(0, len(matched_phrases))) as int), unnest(matched_phrases) from json_cues)
select table_name, record_id, position, {_formed("x", "form")} as unified, {_formed("x", "look")} as unified_look, {_formed("x", "capitals")} as unified_capitals from texts"""


ORACLES: dict[str, str] = {
    "p5_found": _looks_sql(),
    "p5_unified": _unified_sql(),
    "p8_mix_characters": f"with {_MIX} select * from mix where copies > 0",
    "p8_shares_characters": f"""with {_MIX}, got as (select source, sum(tokens * copies) as mixed_tokens, count(*) as documents, max(copies) as most_copies from mix where copies > 0 group by source)
select p.source, target_share, size::bigint as size, max_repeats, most < wanted as short, coalesce(mixed_tokens, 0)::bigint as mixed_tokens, coalesce(documents, 0) as documents,
  coalesce(most_copies, 0) as most_copies, coalesce(mixed_tokens / (select sum(mixed_tokens) from got), 0) as actual_share from plan p left join got g on p.source = g.source""",
    "p2_found": f"with {_RUNS} select path, arg_min(ordinal, n) as first_ordinal, arg_max(ordinal, n) as last_ordinal from runs group by path, run having count(*) >= 2",
    "p2_collapsed": f"""with {_RUNS} select path, arg_min(ordinal, n) as first_ordinal, arg_max(ordinal, n) as last_ordinal, count(*) as count,
  min(start_ms) as start_ms, max(end_ms) as end_ms, max(end_ms) - min(start_ms) as duration from runs group by path, run""",
    "p6_found": f"with {_SITE_LINES} {_FOUND6}",
    "p6_lines": f"with {_SITE_LINES} select source, key, documents, files from repeated",
    "p6_cleaned": f"with {_SITE_LINES} select match_id, path, id, text from json_cues where match_id not in ({_FOUND6})",
    "p7_passages": f"""with {_WORDS},
dw as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as p from doc_words),
iw as (select item_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as q from item_words),
same as (select doc_id, item_id, p - q as shift, p from dw join iw using (word)),
diagonals as (select doc_id, item_id, shift from same group by all having count(*) >= 12),
steps as (select *, p - lag(p) over w as step from same semi join diagonals using (doc_id, item_id, shift) window w as (partition by doc_id, item_id, shift order by p)),
marked as (select *, sum(case when step <= 2 then 0 else 1 end) over w as stretch, sum(case when step = 1 then 0 else 1 end) over w as run_of from steps window w as (partition by doc_id, item_id, shift order by p)),
runs as (select doc_id, item_id, shift, stretch, run_of, count(*) as n, min(p) as a, max(p) as b from marked group by all)
select doc_id, item_id, min(a) as doc_word, min(a) - shift as item_word, max(b) - min(a) + 1 as words, (max(b) - min(a) + 1 - sum(n))::bigint as substituted, max(n) as run
from runs group by doc_id, item_id, shift, stretch having sum(n) >= 12""",
    "p7_found": rf"""with {_WORDS},
item_windows as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as passage from (select item_id, w, unnest(range(1, len(w) - 10)) as i from item_words)),
doc_windows as (select doc_id, array_to_string(w[i:i + 11], ' ') as passage from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from doc_words))
select distinct doc_id, item_id from doc_windows join item_windows using (passage)""",
    "p9_found": f"""with {_STATISTICS}
select doc_id from ratios where tokens < 20 or mean_length < 2.5 or mean_length > 9 or symbol_share > 0.25 or ended_share < 0.25 or common_share < 0.1""",
    "p9_statistics": f"with {_STATISTICS} select * from ratios",
    "p9_chunked": f"with {_STATISTICS} select * from ratios",
}
