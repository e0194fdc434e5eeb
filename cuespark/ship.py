"""The package itself, sent to the executors once per application."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "_cuespark_shipped"


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in the Python workers, wherever the driver found it; gives the session back."""
    context = spark.sparkContext
    if not getattr(context, _SHIPPED, False):
        home = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="ship-")  # on the driver, which serves it to the executors
        archive = os.path.join(folder, "cuespark_package.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for at, folders, names in os.walk(home):
                folders.sort()
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join(os.path.basename(home), os.path.relpath(path, home)))
        context.addPyFile(archive)
        setattr(context, _SHIPPED, True)
    return spark
