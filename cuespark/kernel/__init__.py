"""Pure Python kernels: bytes to cues and back. No module here imports Spark."""
