"""The shared folder of the cluster: written intermediate results that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def _setting(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def _need_cluster_setting(spark: SparkSession) -> None:
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the folder in ``spark.checkpoint.dir`` and read back from there.

    Only where that setting is absent, as in local tests, is a temporary folder taken; on a cluster
    it must name a folder that all executors share.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = _setting(spark)
        if not folder:
            _need_cluster_setting(spark)
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return frame.checkpoint()


def snapshot(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the shared folder as Parquet, so that its readers take only the columns they need."""
    spark = frame.sparkSession
    folder = _setting(spark)
    if not folder:
        _need_cluster_setting(spark)
        folder = tempfile.mkdtemp(prefix="snapshots-")
    at = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    if urlparse(at).scheme in ("", "file"):
        atexit.register(shutil.rmtree, urlparse(at).path, ignore_errors=True)
    frame.write.parquet(at)
    return spark.read.schema(frame.schema).parquet(at)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, as a local path, that all executors share and that goes when the driver ends; ``spark.checkpoint.dir`` must be on a mounted file system."""
    folder = _setting(spark)
    if not folder:
        _need_cluster_setting(spark)
        made = tempfile.mkdtemp(prefix=f"{name}-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        return made
    place = urlparse(folder)
    if place.scheme not in ("", "file"):
        raise ValueError(f"{folder} is no mounted folder")
    made = os.path.join(place.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(made)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made
