"""The messages of failures, which callers compare."""

BAD_UTF8 = "malformed UTF-8"
ODD_UTF16 = "odd-length UTF-16 data"
HIGH_SURROGATE = "unpaired high surrogate in UTF-16 data"
LOW_SURROGATE = "unpaired low surrogate in UTF-16 data"
VTT_ENCODING = "WebVTT must be UTF-8; {} BOM found"

SRT_ID = "expected a numeric SRT cue ID"
SRT_NO_TIMING = "SRT cue is missing a timing line"
SRT_TIMING = "invalid SRT timing line"
SRT_BACKWARDS = "SRT cue ends before it starts"
SRT_EMPTY = "SRT cue has no payload"
SRT_RUN_ON = "SRT cues must be separated by a blank line"

VTT_MISSING = "WebVTT file is missing the WEBVTT header"
VTT_HEADER = "invalid WebVTT header"
VTT_HEADER_END = "WebVTT header must be followed by a blank line"
VTT_BLOCK = "invalid WebVTT block: expected cue timing"
VTT_EMPTY = "WebVTT cue has no payload"
VTT_SEPARATOR = "invalid WebVTT timing separator"
VTT_TIMING = "invalid WebVTT timing line"
VTT_START = "invalid WebVTT start time: {}"
VTT_END = "invalid WebVTT end time: {}"
VTT_BACKWARDS = "WebVTT cue ends before it starts"

ASS_RECORD = "invalid ASS Events record"
ASS_EARLY = "ASS Dialogue appears before an Events Format declaration"
ASS_SHORT = "ASS Dialogue has fewer fields than the active Format"
ASS_START = "invalid ASS start time: {}"
ASS_END = "invalid ASS end time: {}"
ASS_BACKWARDS = "ASS Dialogue ends before it starts"
ASS_EMPTY_FIELD = "ASS Events Format contains an empty field"
ASS_REPEATED = "ASS Events Format repeats field {}"
ASS_FIELDS = "ASS Events Format must contain Start, End, and Text"
ASS_TEXT_LAST = "ASS Events Format Text field must be last"

CLOCK_SEPARATOR = "timestamp {} has no fractional separator"
CLOCK_FRACTION = "invalid timestamp fraction in {}"
CLOCK = "invalid timestamp {}"
CLOCK_WIDTH = "invalid timestamp field width in {}"
CLOCK_RANGE = "timestamp field out of range in {}"
CLOCK_SIZE = "timestamp {} is too large"

UNSUPPORTED = "unsupported subtitle format"
UNKNOWN_CUE = "unknown cue ID {}"
