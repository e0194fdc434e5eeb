"""Deletion of whole cues; every other byte stays as it is."""

from __future__ import annotations

import json
from collections.abc import Iterable

from cuespark.kernel import messages as M
from cuespark.kernel.formats import Document, parse
from cuespark.kernel.source import Malformed


def splice(content: bytes, edits: Iterable[tuple[int, int, bytes]]) -> bytes:
    """``content`` with (start, end, replacement) applied; edits must lie in it and not overlap."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1])):
        if not at <= start <= end <= len(content):
            raise ValueError("byte edits overlap or lie outside of the file")
        out += (content[at:start], new)
        at = end
    return b"".join([*out, content[at:]])


def delete_cues(content: bytes, document: Document, cue_ids: Iterable[str]) -> bytes:
    """``content`` without the named cues. No ids: unchanged; repeated ids count once; an unknown id is an error.

    The numbers of the remaining SRT cues become 1, 2, ... in source order.
    """
    gone = set(cue_ids)
    unknown = gone - {c.cue_id for c in document.cues}
    if unknown:
        raise Malformed(M.UNKNOWN_CUE.format(json.dumps(sorted(unknown)[0], ensure_ascii=False)))
    if not gone:
        return content
    kept = [c for c in document.cues if c.cue_id not in gone]
    edits = [(*c.delete_span, b"") for c in document.cues if c.cue_id in gone]
    edits += [(*c.index_span, document.source.encode(str(n))) for n, c in enumerate(kept, 1) if c.index_span]
    return splice(content, edits)


def validate_deletion(content: bytes, document: Document, cue_ids: Iterable[str], rendered: bytes) -> str | None:
    """Null if ``rendered`` is the deletion's result, parses, and has as many cues less as were named; else why not."""
    gone = set(cue_ids)
    if delete_cues(content, document, gone) != rendered:
        return "rendered bytes differ from the deletion's result"
    try:
        left = parse(rendered, document.form)
    except Malformed as e:
        return f"rendered file is invalid: {e.message}"
    if len(left.cues) != len(document.cues) - len(gone):
        return f"rendered file has {len(left.cues)} cues instead of {len(document.cues) - len(gone)}"
    return None
