"""Scalar functions on columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespark.functions.unsafe import UNSAFE
from cuespark.kernel import texts
from cuespark.kernel.formats import FORMATS, MOST_MS
from cuespark.kernel.texts import WHITE

_WHITE_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITE) + "]"


def _each(kernel: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    """A kernel over a column, once for each distinct value of a batch; null stays null."""

    def over(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        made = pd.Series([kernel(x) for x in distinct] + [None], dtype=object)
        return made.take(codes).reset_index(drop=True) if len(values) else values

    return over


def _text_udf(kernel: Callable[[str], str]) -> Callable[[Column | str], Column]:
    over = _each(kernel)

    def run(values: pd.Series) -> pd.Series:
        return over(values)

    made = F.pandas_udf(run, "string")
    return lambda column: made(column)


def normalize_search(text: Column | str) -> Column:
    """Composed, fully case-folded, composed again, white space as single blanks."""
    return _text_udf(texts.normalize_search)(text)


def normalize_display(text: Column | str) -> Column:
    """Composed, white space as single blanks."""
    return _text_udf(texts.normalize_display)(text)


def visible_markup(text: Column | str, timestamps: bool = False) -> Column:
    """Text without the known tags and with decoded references; with ``timestamps`` cue times in tags go too."""
    return _text_udf(lambda x: texts.visible_markup(x, timestamps))(text)


def visible_ass(text: Column | str) -> Column:
    """Text outside of override blocks and drawings."""
    return _text_udf(texts.visible_ass)(text)


def white_collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the edges."""
    return F.trim(F.regexp_replace(text, _WHITE_CLASS + "+", " "))


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{_WHITE_CLASS}*\\z")


def is_digits(text: Column) -> Column:
    """One or more ASCII digits and nothing else."""
    return text.rlike(r"^[0-9]+\z")


def numeric_token(text: Column) -> Column:
    """The number of a line of ASCII digits with blanks and tabs around it; null for other lines."""
    return F.nullif(F.regexp_extract(text, r"^[ \t]*([0-9]+)[ \t]*\z", 1), F.lit(""))


def vtt_metadata(first_line: Column) -> Column:
    """Whether a block that begins with this line is a note, style or region."""
    bare = F.regexp_replace(first_line, f"^{_WHITE_CLASS}+|{_WHITE_CLASS}+\\z", "")
    return F.upper(bare).rlike(r"(?s)^(NOTE([ \t].*)?|STYLE|REGION)\z")


def detect_format(path: Column) -> Column:
    """srt, ass or webvtt by the last extension in any case; null for others."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    out = F.when(F.lit(False), F.lit(""))
    for known, form in FORMATS.items():
        out = out.when(extension == known, F.lit(form))
    return out


def byte_order_mark(content: Column) -> Column:
    """utf-16le-bom, utf-16be-bom, utf-8-bom or utf-8, by the first bytes."""
    two, three = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 3))
    return F.when(two == "FFFE", "utf-16le-bom").when(two == "FEFF", "utf-16be-bom").when(three == "EFBBBF", "utf-8-bom").when(content.isNotNull(), "utf-8")


def line_array(text: Column) -> Column:
    """The lines of a text, ended by LF, CR LF or CR; a terminator at the end begins no further line."""
    lines = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def cue_id(form: Column, start: Column, end: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", form, start.cast("string"), end.cast("string"), ordinal.cast("string"))


def format_timestamp(ms: Column, separator: str = ".") -> Column:
    """``HH:MM:SS.mmm``, hours with two digits at least; negative times are zero."""
    t = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    part = lambda unit, of: F.pmod(F.floor(t / unit), F.lit(of)).cast("bigint")
    shown = F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(t / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(t, F.lit(1000)))
    return F.when(ms.isNotNull(), shown)


def cue_view(start: Column, end: Column, text: Column) -> Column:
    """A cue as it is shown in lists: its times and its text."""
    return F.concat(format_timestamp(start), F.lit(" → "), format_timestamp(end), F.lit("  "), text)


def line_window(text: Column, width: int, offset: int, count: int) -> Column:
    """``lines``, ``before``, ``after``, ``offset`` of a text in a view of ``count`` lines of ``width`` columns."""
    from cuespark.kernel.lines import line_window as window

    @F.pandas_udf("lines array<string>, before boolean, after boolean, offset int")
    def made(values: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if v is None else tuple(window(v, width, offset, count)) for v in values]
        return pd.DataFrame(rows, columns=["lines", "before", "after", "offset"], dtype=object)

    return made(text)


def parse_clock(value: Column, separators: str, short: bool = False) -> Column:
    """Milliseconds of a clock text, null if it is none or too large; ``short`` allows missing hours."""
    bare = F.regexp_replace(value, f"^{_WHITE_CLASS}+|{_WHITE_CLASS}+\\z", "")
    form = rf"^(?:([0-9]+):){'?' if short else ''}([0-5][0-9]):([0-5][0-9])[{separators}]([0-9]{{1,3}})\z"
    group = lambda i: F.regexp_extract(bare, form, i)
    wide = "decimal(38,0)"
    number = lambda i: F.coalesce(F.nullif(group(i), F.lit("")).try_cast(wide), F.lit(0).cast(wide))
    huge = F.length(F.regexp_replace(group(1), "^0+", "")) > 12
    total = ((number(1) * 60 + number(2)) * 60 + number(3)) * 1000 + F.rpad(group(4), 3, "0").try_cast(wide)
    return F.when(bare.rlike(form) & ~huge & (total <= MOST_MS), total.cast("bigint"))


def sanitize(text: Column) -> Column:
    """Each character that could act on a terminal, or on the direction of text, as U+FFFD."""
    return F.regexp_replace(text, UNSAFE, "�")


# What to_json leaves as it is, though it acts on terminals or on the direction of text.
_RAW_IN_JSON = [0x7F, *range(0x80, 0xA0), 0x61C, 0x200E, 0x200F, *range(0x2028, 0x202F), *range(0x2066, 0x2070)]


def escape_json(document: Column) -> Column:
    """A JSON text with the remaining unsafe characters as ``\\uXXXX``."""
    for point in _RAW_IN_JSON:
        document = F.replace(document, F.lit(chr(point)), F.lit(f"\\u{point:04x}"))
    return document


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def safe_relative(path: Column) -> Column:
    """Whether a path is relative, clean, and stays below its root."""
    parts = F.split(path, "/", -1)
    return F.coalesce(
        (path != "") & ~path.contains("\u0000") & ~path.startswith("/") & ~F.exists(parts, lambda x: x.isin("", ".", "..")), F.lit(False)
    )
