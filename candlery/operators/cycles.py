"""Bars placed in cycles of dated events, and the length of a series' own cycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlery.operators.correlation import safe_corr

# Upgrades of a proof-of-stake chain: day, name, weight by their historical effect.
UPGRADES = [
    ("2020-12-01", "Beacon Chain", 0.7), ("2021-08-05", "London", 0.8), ("2022-09-15", "The Merge", 1.0), ("2023-04-12", "Shanghai", 0.6), ("2024-03-13", "Dencun", 0.6),
]
# Days from which each stage of the move to proof of stake holds, and the first and last day of the move.
STAGES, RAMP = ["2020-12-01", "2022-09-15", "2023-04-12", "2024-03-13"], ("2020-12-01", "2022-09-15")
# Outages of a chain with their impact; days from which each stage of its growth holds.
OUTAGES = [("2021-09-14", 0.9), ("2022-06-01", 0.5), ("2023-02-25", 0.8)]
GROWTH = ["2020-03-16", "2021-05-26", "2022-02-02", "2023-06-23"]


def calendar_of(df: DataFrame, events: Sequence[tuple]) -> DataFrame:
    """day, name, weight of listed events as a frame of the same session."""
    return df.sparkSession.createDataFrame([(d, n, float(w)) for d, n, w in events], "day string, name string, weight double").withColumn("day", F.to_date("day"))


def event_position(bars: DataFrame, events: DataFrame, time: str = "open_time") -> DataFrame:
    """The bars with since (days since the latest event), until (days to the next one), phase (share of the way between them),
    log_since, phase_sin, phase_cos, event and weight of the latest event; null where there is no such event.

    Days are joined, not bars: each day of the bars' span gets its events once, by a union in order of time. The later of
    events on one day counts.
    """
    days = bars.select(F.to_date(time).alias("day")).distinct()
    latest = events.groupBy("day").agg(F.max(F.struct("name", "weight")).alias("e"))
    both = days.withColumn("e", F.lit(None).cast(latest.schema["e"].dataType)).withColumn("is_day", F.lit(1)).unionByName(latest.withColumn("is_day", F.lit(0)))
    w = Window.orderBy("day", "is_day")  # days of a calendar, not bars
    at = F.when(F.col("is_day") == 0, F.col("day"))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("day"), F.desc("is_day")).rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumns({"_at": F.last(at, True).over(before), "_next": F.last(at, True).over(after), "_e": F.last("e", True).over(before)}).where("is_day = 1")
    since, until = F.datediff("day", F.col("_at")), F.datediff(F.col("_next"), F.col("day"))
    phase = F.try_divide(since, since + until)
    found = placed.select(
        F.col("day").alias("_day"), since.alias("since"), until.alias("until"), phase.alias("phase"), F.log1p(since).alias("log_since"), F.sin(2 * F.pi() * phase).alias("phase_sin"),
        F.cos(2 * F.pi() * phase).alias("phase_cos"), F.col("_e.name").alias("event"), F.col("_e.weight").alias("weight"),
    )
    return bars.join(found, F.to_date(time) == F.col("_day"), "left").drop("_day")


def stage(time: str, days: Sequence[str]) -> Column:
    """How many of the listed days have come."""
    return sum((F.when(F.to_date(time) >= F.to_date(F.lit(d)), 1).otherwise(0) for d in days), F.lit(0))


def ramp(time: str, first: str, last: str) -> Column:
    """0 before the first day, 1 from the last one on, the share of the way between."""
    a, b = F.to_date(F.lit(first)), F.to_date(F.lit(last))
    share = F.datediff(F.to_date(time), a) / F.datediff(b, a)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def stability(time: str, outages: Sequence[tuple[str, float]], decay: float = 0.01) -> Column:
    """1 less the impact of the latest outage, which fades with the days since it; 1 before the first one."""
    score = F.lit(1.0)
    for day, impact in outages:
        since = F.datediff(F.to_date(time), F.to_date(F.lit(day)))
        score = F.when(since >= 0, 1 - impact * F.exp(-decay * since)).otherwise(score)
    return score


def lag_correlations(bars: DataFrame, first: int = 7, last: int = 365, least: int = 10) -> DataFrame:
    """symbol, lag_days, n, corr: correlation of returns with those so many bars before, for every lag, of at least ``least``
    pairs. Returns are joined to themselves by row number, one row for each lag."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    rows = bars.select("symbol", F.row_number().over(w).alias("rn"), (F.try_divide("close", F.lag("close").over(w)) - 1).alias("x")).where("x is not null")
    later = rows.select("symbol", F.col("rn").alias("at"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("lag_days"))
    pairs = later.join(rows, (later["symbol"] == rows["symbol"]) & (later["at"] - later["lag_days"] == rows["rn"])).select(later["symbol"], "lag_days", "x", "y")
    return pairs.groupBy("symbol", "lag_days").agg(F.count("*").alias("n"), safe_corr("x", "y").alias("corr")).where(F.col("n") >= least)


def cycle_length(correlations: DataFrame) -> DataFrame:
    """symbol, lag_days, corr: of the lags whose correlation exceeds both neighbours', the one where it is greatest (the
    shortest of equals); the greatest of all where there is no such lag."""
    w = Window.partitionBy("symbol").orderBy("lag_days")
    peak = (F.col("corr") > F.lag("corr").over(w)) & (F.col("corr") > F.lead("corr").over(w))
    rows = correlations.where("corr is not null").withColumn("peak", F.coalesce(peak, F.lit(False)))
    best = F.max(F.struct("peak", "corr", (-F.col("lag_days")).alias("back"))).alias("b")
    return rows.groupBy("symbol").agg(best).select("symbol", (-F.col("b.back")).alias("lag_days"), F.col("b.corr").alias("corr"))


def one_hot(rows: DataFrame, column: str, values: Sequence, names: Sequence[str] | None = None) -> DataFrame:
    """The rows with a 0/1 column for each known value of one column; a value that isn't known has zeros alone."""
    names = names or [f"{column}_{v}" for v in values]
    return rows.withColumns({n: F.coalesce((F.col(column) == F.lit(v)).cast("long"), F.lit(0).cast("long")) for n, v in zip(names, values, strict=True)})


def calendar_waves(rows: DataFrame, time: str = "open_time") -> DataFrame:
    """The rows with day of week, month, quarter and day of month, and sine and cosine of the weekday, month and week of the year."""
    t = F.col(time)
    parts = {"weekday_no": F.weekday(t).cast("long"), "month_no": F.month(t).cast("long"), "quarter_no": F.quarter(t).cast("long"), "day_no": F.day(t).cast("long")}
    waves = {"weekday": (F.weekday(t), 7), "month": (F.month(t) - 1, 12), "week": (F.weekofyear(t), 52)}
    return rows.withColumns(parts | {f"{n}_{k}": f(2 * F.pi() * x / period) for n, (x, period) in waves.items() for k, f in (("sin", F.sin), ("cos", F.cos))})
