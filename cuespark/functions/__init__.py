"""Column functions: built-in expressions where they are exact, Arrow kernels elsewhere."""

from cuespark.functions.columns import (
    byte_order_mark,
    content_digest,
    cue_id,
    cue_view,
    detect_format,
    escape_json,
    format_timestamp,
    is_blank,
    is_digits,
    line_array,
    line_window,
    normalize_display,
    normalize_search,
    numeric_token,
    parse_clock,
    safe_relative,
    sanitize,
    shell_quote,
    visible_ass,
    visible_markup,
    vtt_metadata,
    white_collapse,
)

__all__ = [
    "byte_order_mark", "content_digest", "cue_id", "cue_view", "detect_format", "escape_json", "format_timestamp", "is_blank", "is_digits", "line_array", "line_window",
    "normalize_display", "normalize_search", "numeric_token", "parse_clock", "safe_relative", "sanitize", "shell_quote", "visible_ass",
    "visible_markup", "vtt_metadata", "white_collapse",
]
