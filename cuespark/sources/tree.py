"""Writing files of a table into a directory tree that all executors share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cuespark.kernel.files import safe_relative


def write_tree(files: DataFrame, root: str) -> int:
    """Writes ``path``, ``content`` below ``root`` and gives the number of files.

    Unsafe paths are an error. A file appears whole or not at all, and a task that is run again
    writes the same bytes, so lost executors do no harm.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if path is None or content is None or not safe_relative(path):
                    raise ValueError(f"can't write {path!r}")
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                staged = f"{at}.{os.getpid()}.part"
                with open(staged, "wb") as f:
                    f.write(content)
                os.replace(staged, at)
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])

    return files.select("path", "content").mapInArrow(kernel, "path string").count()
