"""Data sources."""

from cuespark.sources.subtitles import SubtitleSource, register

__all__ = ["SubtitleSource", "register"]
