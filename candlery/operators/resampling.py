"""Bars of one length into bars of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlery.functions.timeaxis import floor_div
from candlery.operators.cleaning import column_classes

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
#: Lengths that are suggested after one another, in seconds.
LADDER = (60, 300, 900, 3_600, 14_400, 86_400, 604_800)


def seconds_of(time: str) -> Column:
    return F.timestamp_diff("SECOND", F.expr(EPOCH), F.col(time).cast("timestamp_ntz"))


def aggregations(df: DataFrame, apart: Sequence[str], order: Column) -> dict[str, Column]:
    """How each column is combined, by its name and type: first open, highest high, lowest low, last close, sums of volumes
    and counts, means of other numbers, the last id, code or text. First and last skip nulls."""
    out = {}
    for c, kind in column_classes(df, apart).items():
        known = F.when(F.col(c).isNotNull(), order)
        last = F.max_by(c, known)
        out[c] = {"open": F.min_by(c, known), "high": F.max(c), "low": F.min(c), "close": last}.get(c) if kind == "price" else {"sum": F.sum(c), "mean": F.avg(c)}.get(kind, last)
    return out


def resampled(df: DataFrame, keys: Sequence[str], time: str, seconds: int, tie: Sequence[str] = (), origin: str = "first") -> DataFrame:
    """keys, time (start of the bucket) and all other columns combined; buckets hold their start, not their end.

    With ``origin`` "first" buckets count from the first time of each series, with "epoch" from 1970. Combined before the
    shuffle, so a series of any length costs a task only its buckets.
    """
    if origin not in ("first", "epoch"):
        raise ValueError(f"unknown origin: {origin}")
    rows = df.withColumn("_s", seconds_of(time)).where("_s is not null")
    if origin == "first":
        starts = rows.groupBy(*keys).agg(F.min("_s").alias("_o")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_o")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        rows = rows.join(starts, same).drop(*[f"_k{i}" for i in range(len(keys))])
    else:
        rows = rows.withColumn("_o", F.lit(0).cast("long"))
    rows = rows.withColumn("_b", F.col("_o") + seconds * floor_div(F.col("_s") - F.col("_o"), seconds))
    made = aggregations(df, (*keys, time), F.struct("_s", *tie))
    out = rows.groupBy(*keys, "_b").agg(*[x.alias(c) for c, x in made.items()])
    return out.withColumn(time, F.timestamp_add("SECOND", F.col("_b"), F.expr(EPOCH))).select(*keys, time, *made)


def weekly(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str] = ()) -> DataFrame:
    """Bars from Monday to Sunday, labelled with the Sunday before."""
    made = aggregations(df, (*keys, time), F.struct(seconds_of(time), *tie))
    week = F.date_sub(F.date_trunc("week", F.col(time)), 1).cast("timestamp_ntz")
    return df.groupBy(*keys, week.alias("_w")).agg(*[x.alias(c) for c, x in made.items()]).select(*keys, F.col("_w").alias(time), *made)


def on_grid(df: DataFrame, keys: Sequence[str], time: str, seconds: int) -> DataFrame:
    """A row for every step between the first and last row of a series; columns of steps without one are null."""
    rows = df.withColumn("_s", seconds_of(time))
    spans = rows.groupBy(*keys).agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    slots = spans.select(*keys, F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("_s"))
    rest = [c for c in df.columns if c not in (*keys, time)]
    return slots.join(rows.drop(time), [*keys, "_s"], "left").select(*keys, F.timestamp_add("SECOND", F.col("_s"), F.expr(EPOCH)).alias(time), *rest)


def suggested_lengths(seconds: int, most: int = 4) -> list[int]:
    """Up to ``most`` longer lengths that whole bars of ``seconds`` make up."""
    return [x for x in LADDER if x > seconds and x % seconds == 0][:most]


def auto_resampled(df: DataFrame, keys: Sequence[str], time: str, seconds: int, tie: Sequence[str] = ()) -> DataFrame:
    """The bars of each suggested length below one another, told apart by length_s."""
    made = [resampled(df, keys, time, n, tie, "epoch").withColumn("length_s", F.lit(n).cast("long")) for n in suggested_lengths(seconds)]
    if not made:
        raise ValueError(f"no longer length for {seconds} seconds")
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out
