"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
