"""Access to the tables of a data directory (one Parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` of ``directory``."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
