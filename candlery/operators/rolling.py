"""Rolling totals over trailing calendar days (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlery.functions.timeaxis import floor_div, timeframe_label
from candlery.operators.bars import SERIES, feed, latest_bars


def daily_totals(bars: DataFrame) -> DataFrame:
    """feed_id, tf, day (days since 1970) and its totals, only for days with a bar.

    A null volume or close adds nothing; a day whose bars have neither still counts as a day of the series.
    """
    seen = latest_bars(bars, "volume", "close")
    day = floor_div(F.col("per") * F.col("tf"), 86_400)
    return (
        seen.withColumn("day", day)
        .groupBy(*SERIES, "day")
        .agg(
            F.count("*").alias("bars"),
            F.count_if(F.col("volume") > 0).alias("active"),
            F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
            F.coalesce(F.sum("close"), F.lit(0.0)).alias("close"),
            F.count("close").alias("closes"),
        )
    )


def rolling_totals(bars: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages of volume and close over the trailing days of each series, one row per calendar day.

    Columns: feed_id, timeframe, day_utc, series_day (1 for the first), and for each window n: bars_n, active_n (bars
    with volume above zero), volume_total_n, volume_avg_n, close_total_n, close_avg_n. Averages divide by n, whatever the
    number of days with bars (fixed denominator); close_mean_n divides the closes by their number instead and is null
    without any. Empty input gives no rows; a series of one bar gives one day.

    Plan: sparse daily totals (combined before the shuffle), then one shuffle by series in which the gap to the next
    day with bars is exploded into calendar rows and range frames over the integer day number are summed. A series has
    at most one row a day there, so its size is bounded by the calendar, not by its bars.
    """
    series = Window.partitionBy(*SERIES)
    days = daily_totals(bars).withColumn("next_day", F.lead("day").over(series.orderBy("day")))
    last = F.coalesce(F.col("next_day") - 1, F.col("day"))
    zero = {"bars": F.lit(0), "active": F.lit(0), "volume": F.lit(0.0), "close": F.lit(0.0), "closes": F.lit(0)}
    calendar = days.withColumn("d", F.explode(F.sequence(F.col("day"), last))).withColumns(
        {k: F.when(F.col("d") == F.col("day"), F.col(k)).otherwise(v) for k, v in zero.items()}
    )
    ordered = series.orderBy("d")
    columns = []
    for n in windows:
        frame = ordered.rangeBetween(-(n - 1), 0)
        total = {k: F.sum(k).over(frame) for k in zero}
        columns += [
            total["bars"].alias(f"bars_{n}"),
            total["active"].alias(f"active_{n}"),
            total["volume"].alias(f"volume_total_{n}"),
            (total["volume"] / n).alias(f"volume_avg_{n}"),
            total["close"].alias(f"close_total_{n}"),
            (total["close"] / n).alias(f"close_avg_{n}"),
            F.try_divide(total["close"], total["closes"]).alias(f"close_mean_{n}"),
        ]
    return calendar.select(
        feed(),
        timeframe_label(F.col("tf")).alias("timeframe"),
        F.date_format(F.date_from_unix_date(F.col("d").cast("int")), "yyyy-MM-dd").alias("day_utc"),
        (F.col("d") - F.min("day").over(series) + 1).alias("series_day"),
        *columns,
    )


def idle_days(bars: DataFrame, window: int = 7) -> DataFrame:
    """feed_id, timeframe, day_utc of the days on which the trailing ``window`` days, all of the series, saw no volume."""
    rolled = rolling_totals(bars, [window])
    return rolled.where((F.col("series_day") >= window) & (F.col(f"active_{window}") == 0)).select("feed_id", "timeframe", "day_utc")
