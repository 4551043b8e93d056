"""Integer time axes: microseconds since 1970, timeframe labels, period numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
DAY = 86_400 * SECOND

# Unit spellings and their length in seconds.
UNIT_SECONDS = {
    "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "t": 60,
    "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600,
    "d": 86400, "day": 86400, "days": 86400,
    "w": 604800, "wk": 604800, "week": 604800, "weeks": 604800,
}


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a timestamp column; zone-less values mean UTC whatever the session zone."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(col.cast("timestamp"))


def utc_text(us: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text of microseconds since 1970 in UTC, independent of the session zone."""
    wall = F.timestamp_add("MICROSECOND", us, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(wall, pattern)


def timeframe_seconds(label: Column) -> Column:
    """Length in seconds of a label such as ``1m``, ``60s``, ``4 hours``, ``1D``; null if it is none."""
    text = F.trim(label)
    rest = F.ltrim(text, F.lit("0123456789"))
    unit = F.ltrim(rest)
    count = F.substring(text, F.lit(1), F.length(text) - F.length(rest)).try_cast("long")
    by_length: dict[int, list[str]] = {}
    for name, seconds in UNIT_SECONDS.items():
        by_length.setdefault(seconds, []).append(name)
    length = F.lit(None).cast("long")
    for seconds, names in by_length.items():
        length = F.when(F.lower(unit).isin(names), F.lit(seconds).cast("long")).otherwise(length)
    # a lone capital M is a calendar month, which has no fixed length
    return F.when((unit != "M") & (count > 0) & (count < 1_000_000), count * length)


def timeframe_label(seconds: Column) -> Column:
    """Canonical label of a length in seconds, in the largest unit that divides it."""
    return (
        F.when(seconds % 604800 == 0, F.concat((seconds / 604800).cast("long").cast("string"), F.lit("w")))
        .when(seconds % 86400 == 0, F.concat((seconds / 86400).cast("long").cast("string"), F.lit("d")))
        .when(seconds % 3600 == 0, F.concat((seconds / 3600).cast("long").cast("string"), F.lit("h")))
        .when(seconds % 60 == 0, F.concat((seconds / 60).cast("long").cast("string"), F.lit("m")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )


def floor_div(a: Column, b: Column | int) -> Column:
    """Floor division of longs, right below zero too; b is not zero.

    Never null for Catalyst, so joins on the result infer no null filters that would repeat its expressions below.
    """
    b = F.lit(b) if isinstance(b, int) else b
    return F.coalesce(F.call_function("div", a - F.pmod(a, b), b), F.lit(0).cast("long"))
