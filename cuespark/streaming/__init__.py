"""Continuous ingest of files and of cues."""

from cuespark.streaming.ingest import match_stream, stream_files, windowed_counts

__all__ = ["match_stream", "stream_files", "windowed_counts"]
