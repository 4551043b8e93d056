"""Scans with conditions, sources by name with one time column, gaps filled from a second source, SQL with parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.functions.timeaxis import timeframe_seconds

#: Names that a time column may have, by preference.
TIMES = ("open_time", "timestamp", "time_bucket", "ts", "o_orderdate")


def scan_bars(bars: DataFrame, timeframe: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None, **equal: object) -> DataFrame:
    """Bars of a timeframe (any spelling of its length) and span, both ends included, newest first; conditions and columns
    reach the scan. ``limit`` keeps the newest ones."""
    rows = bars
    for name, value in equal.items():
        rows = rows.where(F.col(name) == F.lit(value))
    if timeframe is not None:
        rows = rows.where(timeframe_seconds(F.col("timeframe")) == timeframe_seconds(F.lit(timeframe)))
    for bound, holds in ((start, F.col("open_time") >= F.lit(start).cast("timestamp_ntz")), (end, F.col("open_time") <= F.lit(end).cast("timestamp_ntz"))):
        if bound is not None:
            rows = rows.where(holds)
    if limit is None:
        return rows
    return rows.orderBy(F.desc("open_time"), *[c for c in rows.columns if c != "open_time"]).limit(limit)


def load(spark: SparkSession, folder: str, source: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table by name with its time as open_time; raises for a table without any."""
    rows = spark.read.parquet(f"{folder}/{source}.parquet")
    named = [t for t in TIMES if t in rows.columns]
    if not named:
        raise ValueError(f"{source} has no time column")
    rows = rows.withColumnRenamed(named[0], "open_time")
    return rows if columns is None else rows.select("open_time", *columns)


def filled_from(rows: DataFrame, other: DataFrame, keys: Sequence[str], mark: str = "filled") -> DataFrame:
    """rows and those of ``other`` whose key they lack, with ``mark`` 0 and 1."""
    lacking = other.join(rows.select(*keys).distinct(), list(keys), "left_anti")
    return rows.withColumn(mark, F.lit(0)).unionByName(lacking.select(*rows.columns).withColumn(mark, F.lit(1)))


def run_sql(spark: SparkSession, text: str, values: dict | None = None, **frames: DataFrame) -> DataFrame:
    """SQL over named frames ({name} in the text) with named parameters (:name), which are never part of the text."""
    return spark.sql(text, args=values or {}, **frames)


def dimension(rows: DataFrame, column: str, key: str) -> DataFrame:
    """key, column: each value with a number, in their order from 1; null values have none. Values of a dimension are few."""
    from pyspark.sql import Window

    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return values.select(F.row_number().over(Window.orderBy(column)).cast("long").alias(key), column)
