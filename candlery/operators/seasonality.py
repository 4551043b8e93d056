"""Aggregations of bars: weekdays, months, seasons of volatility, risk, runs, cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _order() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def _ret() -> Column:
    return F.try_divide(F.col("close"), F.lag("close").over(_order())) - 1


def _r(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)


def weekday_stats(bars: DataFrame) -> DataFrame:
    """Returns per symbol and weekday (Monday 0): mean, median, spread, extremes, shares of rises and falls, mean close."""
    rows = bars.withColumn("ret", _ret()).where("ret is not null")
    return rows.groupBy("symbol", F.weekday("open_time").cast("long").alias("dow")).agg(
        F.count("*").alias("n"), _r(F.avg("ret"), "mean_ret"), _r(F.median("ret"), "median_ret"), _r(F.stddev_samp("ret"), "std_ret"), _r(F.max("ret"), "max_ret"), _r(F.min("ret"), "min_ret"),
        _r(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)), "up_share"), _r(F.avg(F.when(F.col("ret") < 0, 1.0).otherwise(0.0)), "down_share"), _r(F.avg("close"), "mean_close"),
    )


def monthly_stats(bars: DataFrame) -> DataFrame:
    """Monthly returns (last over first close) per symbol and calendar month: mean, spread, count, z-score of the mean."""
    months = bars.groupBy("symbol", F.year("open_time").alias("y"), F.month("open_time").alias("m")).agg(F.min_by("close", "open_time").alias("a"), F.max_by("close", "open_time").alias("b"))
    months = months.withColumn("ret", F.try_divide("b", "a") - 1)
    each = months.groupBy("symbol", "m").agg(F.count("*").alias("years"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"))
    whole = Window.partitionBy("symbol")
    z = F.try_divide(F.col("mean_ret") - F.avg("mean_ret").over(whole), F.nullif(F.stddev_pop("mean_ret").over(whole), F.lit(0.0)))
    rows = each.withColumn("z", z)
    return rows.select("symbol", F.col("m").cast("long").alias("month_no"), "years", _r(F.col("mean_ret"), "mean_ret"), _r(F.col("std_ret"), "std_ret"), _r(F.col("z"), "z"), F.when(F.abs("z") > 1.96, 1).otherwise(0).cast("long").alias("significant"))


def volatility_seasons(bars: DataFrame) -> DataFrame:
    """Mean absolute log return per symbol by hour, weekday, day of month and month, in long form."""
    step = F.abs(F.ln(F.col("close")) - F.ln(F.lag("close").over(_order())))
    rows = bars.where("close > 0").withColumn("x", step).where("x is not null")
    parts = {"hour": F.hour("open_time"), "weekday": F.weekday("open_time"), "day": F.day("open_time"), "month": F.month("open_time")}
    long = rows.select("symbol", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("season"), v.cast("long").alias("slot")) for k, v in parts.items()])).alias("s"))
    return long.groupBy("symbol", "s.season", "s.slot").agg(F.count("*").alias("n"), _r(F.avg("x"), "mean_abs_ret"))


def risk(bars: DataFrame) -> DataFrame:
    """Value at risk and its mean excess at 95 and 99 percent, Sharpe ratio over 365 periods, deepest fall of summed returns."""
    rows = bars.withColumn("ret", _ret()).where("ret is not null")
    limits = rows.groupBy("symbol").agg(F.percentile("ret", 0.05).alias("v95"), F.percentile("ret", 0.01).alias("v99"))
    running = F.sum("ret").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("total", running)
    rows = rows.withColumn("drawdown", F.col("total") - F.max("total").over(_order().rowsBetween(Window.unboundedPreceding, 0))).join(limits, "symbol")
    return rows.groupBy("symbol").agg(
        _r(F.first("v95"), "var_95"), _r(F.first("v99"), "var_99"), _r(F.avg(F.when(F.col("ret") <= F.col("v95"), F.col("ret"))), "cvar_95"), _r(F.avg(F.when(F.col("ret") <= F.col("v99"), F.col("ret"))), "cvar_99"),
        _r(F.try_divide(F.avg("ret"), F.nullif(F.stddev_samp("ret"), F.lit(0.0))) * F.sqrt(F.lit(365.0)), "sharpe"), _r(F.min("drawdown"), "max_drawdown"),
    )


def trend_runs(bars: DataFrame) -> DataFrame:
    """Runs of rises and falls per symbol (gaps and islands): number, longest, mean length and the current one."""
    side = F.signum(F.col("close") - F.lag("close").over(_order()))
    rows = bars.withColumn("side", side).where("side is not null")
    rows = rows.withColumn("fresh", F.when(F.col("side") != F.coalesce(F.lag("side").over(_order()), F.lit(9.0)), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "run").agg(F.count("*").alias("bars"), F.first("side").alias("side"))
    return runs.groupBy("symbol").agg(F.count("*").alias("runs"), F.max("bars").alias("longest"), _r(F.avg("bars"), "mean_bars"), F.max_by("bars", "run").alias("current_bars"), F.max_by("side", "run").cast("long").alias("current_side"))


def fibonacci(bars: DataFrame, lookback: int = 30) -> DataFrame:
    """Retracement and extension levels of the swing of the last ``lookback`` bars of each symbol, in long form."""
    newest = bars.withColumn("rk", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))).where(f"rk <= {lookback}")
    swing = newest.groupBy("symbol").agg(F.max("high").alias("top"), F.min("low").alias("bottom"), F.max_by("open_time", "high").alias("top_at"), F.min_by("open_time", "low").alias("bottom_at"))
    levels = [0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.414, 1.618, 2.0, 2.618]
    rising = F.col("bottom_at") < F.col("top_at")
    span = F.col("top") - F.col("bottom")
    each = swing.select("symbol", "top", "bottom", rising.alias("rising"), span.alias("span"), F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    price = F.when(F.col("rising"), F.col("top") - F.col("level") * F.col("span")).otherwise(F.col("bottom") + F.col("level") * F.col("span"))
    return each.select("symbol", "level", _r(price, "price"), F.when(F.col("rising"), 1).otherwise(0).cast("long").alias("rising"))


def trend_metrics(bars: DataFrame, n: int = 20) -> DataFrame:
    """Line through the last n closes of each symbol (slope, intercept, fit), speed, efficiency and volume factor."""
    newest = bars.withColumn("rk", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))).where(f"rk <= {n}").withColumn("x", (n - F.col("rk")).cast("double"))
    steps = newest.withColumn("step", F.abs(F.col("close") - F.lag("close").over(_order())))
    found = steps.groupBy("symbol").agg(
        F.regr_slope("close", "x").alias("slope"), F.regr_intercept("close", "x").alias("intercept"), F.regr_r2("close", "x").alias("r2"), F.max_by("close", "x").alias("b"), F.min_by("close", "x").alias("a"),
        F.sum("step").alias("path"), F.avg("volume").alias("v"), F.avg(F.when(F.col("rk") <= 5, F.col("volume"))).alias("v5"),
    )
    return found.select(
        "symbol", _r(F.col("slope"), "slope"), _r(F.col("intercept"), "intercept"), _r(F.col("r2"), "r2"), _r(F.try_divide("b", "a") - 1, "speed"),
        _r(F.try_divide(F.abs(F.col("b") - F.col("a")), F.nullif(F.col("path"), F.lit(0.0))), "efficiency"), _r(F.try_divide("v5", "v"), "volume_factor"),
    )


def similar_stretches(bars: DataFrame, n: int = 20) -> DataFrame:
    """Distance of each symbol's newest n closes to every stretch of n closes that ends before them.

    symbol, bars_back, distance (Euclidean, of closes standardised over the symbol), similarity 1 / (1 + distance).
    """
    whole = Window.partitionBy("symbol")
    rank = F.row_number().over(whole.orderBy(F.desc("open_time")))
    z = F.try_divide(F.col("close") - F.avg("close").over(whole), F.nullif(F.stddev_pop("close").over(whole), F.lit(0.0)))
    rows = bars.select("symbol", rank.alias("rk"), z.alias("z"))
    newest = rows.where(f"rk <= {n}").select("symbol", F.col("rk").alias("now_rk"), F.col("z").alias("now_z"))
    pairs = rows.where(f"rk > {n}").join(newest, "symbol").withColumn("bars_back", (F.col("rk") - F.col("now_rk")).cast("long")).where(f"bars_back >= {n}")
    found = pairs.groupBy("symbol", "bars_back").agg(F.sqrt(F.sum((F.col("now_z") - F.col("z")) ** 2)).alias("dist"), F.count("*").alias("n")).where(f"n = {n}")
    return found.select("symbol", "bars_back", _r(F.col("dist"), "distance"), _r(1 / (1 + F.col("dist")), "similarity"))


def cycle_table(states: DataFrame) -> DataFrame:
    """One row per cycle of the bull/bear automaton: kind, first and last bar, bars, start, end and extreme closes, return."""
    rows = states.where("cycle_no is not null and is_bull is not null")
    found = rows.groupBy("symbol", "cycle_no").agg(
        F.max("is_bull").alias("is_bull"), F.min("open_time").alias("start_at"), F.max("open_time").alias("end_at"), F.count("*").alias("bars"), F.min_by("close", "open_time").alias("start_close"),
        F.max_by("close", "open_time").alias("end_close"), F.max("close").alias("max_close"), F.min("close").alias("min_close"),
    )
    return found.withColumn("roi", F.round(F.try_divide("end_close", "start_close") - 1, 6))


def period_seasonality(bars: DataFrame, part: str = "quarter", years: int = 3) -> DataFrame:
    """symbol, period (month or quarter number), n, mean, sd, rising (share), best_year, worst_year, z, significant: returns from
    the first to the last close of each period of the last ``years`` years with bars; z is that of a period's mean among the
    means of its symbol (population deviation), significant beyond 1.96."""
    if part not in ("month", "quarter"):
        raise ValueError(f"unknown part: {part}")
    last = bars.groupBy("symbol").agg(F.max(F.year("open_time")).alias("_last"))
    number = F.month("open_time") if part == "month" else F.quarter("open_time")
    rows = bars.join(last, "symbol").where(F.year("open_time") > F.col("_last") - years)
    each = rows.groupBy("symbol", F.year("open_time").alias("year"), number.cast("long").alias("period")).agg(F.try_divide(F.max_by("close", "open_time"), F.min_by("close", "open_time")).alias("q"))
    ret = F.col("q") - 1
    found = each.groupBy("symbol", "period").agg(F.count("q").alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.avg(F.when(ret > 0, 1.0).otherwise(0.0)).alias("rising"), F.max_by("year", "q").cast("long").alias("best_year"), F.min_by("year", "q").cast("long").alias("worst_year"))
    w = Window.partitionBy("symbol")  # at most twelve rows a symbol
    found = found.withColumn("z", F.try_divide(F.col("mean") - F.avg("mean").over(w), F.nullif(F.stddev_pop("mean").over(w), F.lit(0.0))))
    return found.withColumn("significant", F.coalesce(F.abs("z") > 1.96, F.lit(False)).cast("long"))


def segment_returns(rows: DataFrame, keys: Sequence[str], segment: str, time: str = "open_time") -> DataFrame:
    """The rows with bar_no (from 1), roi (against the first close of the segment) and roi_z (standardised in the segment)."""
    w = Window.partitionBy(*keys, segment)
    order = w.orderBy(time)
    placed = rows.where(F.col("close").isNotNull()).withColumns({"bar_no": F.row_number().over(order).cast("long"), "roi": F.try_divide("close", F.first("close").over(order.rowsBetween(Window.unboundedPreceding, 0))) - 1})
    stats = placed.groupBy(*keys, segment).agg(F.avg("roi").alias("_m"), F.stddev_pop("roi").alias("_s"))
    return placed.join(stats, [*keys, segment]).withColumn("roi_z", F.try_divide(F.col("roi") - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0)))).drop("_m", "_s")
