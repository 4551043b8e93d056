"""Aggregates over news, forecasts, volatility and pairs of series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlery.operators.correlation import measures, paired, safe_corr


def order():
    return Window.partitionBy("symbol").orderBy("open_time")


# --- news: frames of mentions have item, weight (how often), mood, importance and, where time matters, at


def trending(mentions: DataFrame, top: int = 10, mild: float = 0.1) -> DataFrame:
    """item, mentions, mood, importance, direction of the ``top`` items mentioned most (by name among equals)."""
    found = mentions.groupBy("item").agg(F.sum("weight").alias("mentions"), F.avg("mood").alias("mood"), F.avg("importance").alias("importance"))
    direction = F.when(F.col("mood") > mild, "positive").when(F.col("mood") < -mild, "negative").otherwise("neutral")
    return found.withColumn("direction", direction).orderBy(F.desc("mentions"), "item").limit(top)


def market_signals(mentions: DataFrame, least_importance: float = 0.7, strong: float = 0.5, share: float = 0.6, top: int = 10) -> DataFrame:
    """item, signal, strength, n, good, bad (shares) of the ``top`` strongest items among important news.

    bullish or bearish where two and at least ``share`` of an item's news are beyond ``strong``; items with one piece of news, and neutral ones
    with two, are left out. strength is that share times the mean importance, 1 at most.
    """
    rows = mentions.where(F.col("importance") >= least_importance).groupBy("item")
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("mood") > strong).alias("up"), F.count_if(F.col("mood") < -strong).alias("down"), F.avg("importance").alias("weight"))
    found = found.where("n >= 2").withColumns({"good": F.col("up") / F.col("n"), "bad": F.col("down") / F.col("n")})
    bull, bear = (F.col("good") >= share) & (F.col("up") >= 2), (F.col("bad") >= share) & (F.col("down") >= 2)
    found = found.withColumns({"signal": F.when(bull, "bullish").when(bear, "bearish").otherwise("neutral"), "strength": F.least(F.lit(1.0), F.when(bull, F.col("good")).when(bear, F.col("bad")).otherwise(0.0) * F.col("weight"))})
    return found.where("signal <> 'neutral' or n >= 3").select("item", "signal", "strength", "n", "good", "bad").orderBy(F.desc("strength"), "item").limit(top)


def mood_windows(mentions: DataFrame, seconds: int) -> DataFrame:
    """item, window_no (0 ends at the newest mention), n, weight, mood weighted by it; mentions without time are left out."""
    timed = mentions.where("at is not null")
    newest = timed.agg(F.max("at").alias("newest"))
    # one row: the newest time
    placed = timed.crossJoin(F.broadcast(newest)).withColumn("window_no", F.floor(F.timestamp_diff("SECOND", F.col("at"), F.col("newest")) / seconds))
    return placed.groupBy("item", "window_no").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.try_divide(F.sum(F.col("mood") * F.col("weight")), F.sum("weight")).alias("mood"))


def mood_trends(windows: DataFrame, least: int = 3, change: float = 0.05, top: int = 10) -> DataFrame:
    """kind (rising, falling, volatile), place, item, mean_change, volatility: the ``top`` items of each kind by the changes of
    mood between neighbouring windows that both have ``least`` mentions."""
    numbers = windows.select("window_no").distinct().withColumn("k", F.row_number().over(Window.orderBy("window_no")))  # one row a window
    rows = windows.join(numbers, "window_no").where(F.col("n") >= least)
    w = Window.partitionBy("item").orderBy("k")
    moved = rows.withColumn("moved", F.when(F.lead("k").over(w) == F.col("k") + 1, F.col("mood") - F.lead("mood").over(w))).where("moved is not null")
    each = moved.groupBy("item").agg(F.avg("moved").alias("mean_change"), F.avg(F.abs("moved")).alias("volatility"))
    kinds = {"rising": (F.col("mean_change") > change, F.desc("mean_change")), "falling": (F.col("mean_change") < -change, F.asc("mean_change")), "volatile": (F.lit(True), F.desc("volatility"))}
    out = None
    for kind, (holds, by) in kinds.items():
        best = each.where(holds).orderBy(by, "item").limit(top)
        one = best.withColumns({"kind": F.lit(kind), "place": F.row_number().over(Window.orderBy(by, "item"))})  # at most ``top`` rows
        out = one if out is None else out.unionByName(one)
    return out.select("kind", "place", "item", "mean_change", "volatility")


# --- forecasts: frames have symbol, open_time, model, forecast


def naive_forecasts(bars: DataFrame, mean: int = 5) -> DataFrame:
    """The last close, the mean of the last ones and the last close moved on by the mean step so far, for every bar."""
    before = order().rowsBetween(-mean, -1)
    drift = F.try_divide(F.lag("close").over(order()) - F.first("close").over(order().rowsBetween(Window.unboundedPreceding, 0)), F.row_number().over(order()) - 2)
    made = bars.select("symbol", "open_time", F.lag("close").over(order()).alias("last"), F.when(F.count("close").over(before) == mean, F.avg("close").over(before)).alias(f"mean{mean}"), (F.lag("close").over(order()) + drift).alias("drift"))
    return made.unpivot(["symbol", "open_time"], ["last", f"mean{mean}", "drift"], "model", "forecast").where("forecast is not null")


def forecast_accuracy(forecasts: DataFrame, bars: DataFrame, by: Sequence[str] = ("symbol", "model")) -> DataFrame:
    """n, mse, rmse, mae, mape (of actual values other than zero), r2 of forecasts at the times of bars."""
    both = forecasts.join(bars.select("symbol", "open_time", F.col("close").alias("actual")), ["symbol", "open_time"])
    error = F.col("actual") - F.col("forecast")
    r2 = 1 - F.try_divide(F.sum(error * error), F.nullif(F.var_pop("actual") * F.count("*"), F.lit(0.0)))
    mape = 100 * F.avg(F.abs(F.try_divide(error, "actual")))
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(error * error).alias("mse"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), mape.alias("mape"), r2.alias("r2"))


def ensemble(forecasts: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """One more model, the weighted mean of those that have a forecast for the bar; models without a weight count nothing."""
    weight = F.coalesce(*[F.when(F.col("model") == m, F.lit(float(w))) for m, w in weights.items()])
    rows = forecasts.withColumn("w", weight).where("w is not null")
    made = rows.groupBy("symbol", "open_time").agg(F.try_divide(F.sum(F.col("w") * F.col("forecast")), F.sum("w")).alias("forecast"))
    return made.select("symbol", "open_time", F.lit("ensemble").alias("model"), "forecast")


def forecasts_wide(forecasts: DataFrame, bars: DataFrame, models: Sequence[str]) -> DataFrame:
    """symbol, open_time, actual and a column for each model."""
    wide = forecasts.groupBy("symbol", "open_time").pivot("model", list(models)).agg(F.max("forecast"))
    return wide.join(bars.select("symbol", "open_time", F.col("close").alias("actual")), ["symbol", "open_time"])


def compared_models(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """symbol, model, mse, place (1: least error), fidelity (how much the forecast varies from bar to bar against the close)."""
    both = forecasts.join(bars.select("symbol", "open_time", F.col("close").alias("actual")), ["symbol", "open_time"])
    w = Window.partitionBy("symbol", "model").orderBy("open_time")
    moved = both.withColumns({"df": F.col("forecast") - F.lag("forecast").over(w), "da": F.col("actual") - F.lag("actual").over(w), "e": F.col("actual") - F.col("forecast")})
    found = moved.groupBy("symbol", "model").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.try_divide(F.stddev_samp("df"), F.nullif(F.stddev_samp("da"), F.lit(0.0))).alias("fidelity"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("mse", "model")))


def error_profile(forecasts: DataFrame, bars: DataFrame) -> DataFrame:
    """model, n, mean, sd, bias-corrected skewness and excess kurtosis of the errors, and percentiles of their size."""
    both = forecasts.join(bars.select("symbol", "open_time", F.col("close").alias("actual")), ["symbol", "open_time"]).withColumn("e", F.col("actual") - F.col("forecast"))
    n = F.count("e").cast("double")
    skew = F.when((n > 2) & (F.min("e") < F.max("e")), F.skewness("e") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.min("e") < F.max("e")), ((n + 1) * F.kurtosis("e") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    return both.groupBy("model").agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), skew.alias("skew"), kurt.alias("kurt"), *[F.percentile(F.abs("e"), q / 100).alias(f"p{q}") for q in (50, 75, 90, 95, 99)])


def training_summary(metrics: DataFrame, columns: Sequence[str] = ("rmse", "mae", "r2")) -> DataFrame:
    """model, n and mean, population deviation, least and greatest value of each metric over all runs."""
    fs = {"mean": F.avg, "sd": F.stddev_pop, "min": F.min, "max": F.max}
    return metrics.groupBy("model").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{k}") for c in columns for k, f in fs.items()])


# --- volatility


def term_structure(rows: DataFrame, apart: str, value: str, base: object) -> DataFrame:
    """One row for each length: mean, median, greatest, least and deviation of the value, and the mean against that of ``base``."""
    found = rows.where(F.col(value).isNotNull()).groupBy(apart).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.max(value).alias("most"), F.min(value).alias("least"), F.stddev_samp(value).alias("sd"))
    reference = F.max(F.when(F.col(apart) == F.lit(base), F.col("mean"))).over(Window.partitionBy())  # one row a length
    return found.withColumn("ratio", F.try_divide("mean", reference))


def quantile_regimes(rows: DataFrame, value: str, n: int = 3) -> DataFrame:
    """The rows with regime 0 (calmest) to n - 1: between the n-quantiles of their symbol, upper bounds included."""
    cuts = rows.groupBy("symbol").agg(F.percentile(value, F.lit([k / n for k in range(1, n)])).alias("cuts"))
    return rows.where(F.col(value).isNotNull()).join(cuts, "symbol").withColumn("regime", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")


def frequency_volatility(bars: DataFrame, keys: Sequence[str], time: str = "open_time", window: int = 20) -> DataFrame:
    """keys, time, volatility: rolling deviation of log returns, annualised by the median step of the series: five-minute
    bars or shorter, hourly or shorter, else daily."""
    w = Window.partitionBy(*keys).orderBy(time)
    ratio = F.try_divide("close", F.lag("close").over(w))
    rows = bars.withColumns({"lr": F.when(ratio > 0, F.ln(ratio)), "step": F.timestamp_diff("SECOND", F.lag(time).over(w), F.col(time))})
    steps = rows.groupBy(*keys).agg(F.percentile("step", 0.5).alias("usual"))
    year = F.when(F.col("usual") <= 300, 252 * 24 * 12).when(F.col("usual") <= 3600, 252 * 24).otherwise(252)
    frame = w.rowsBetween(1 - window, 0)
    return rows.join(steps, list(keys)).select(*keys, time, F.when(F.count("lr").over(frame) == window, F.stddev_samp("lr").over(frame) * F.sqrt(year)).alias("volatility"))


def market_snapshot(volatility: DataFrame, value: str = "hist_vol_14", bars: int = 30) -> DataFrame:
    """One row: at the last time, mean and deviation of the symbols' values, mean correlation of pairs and the change of the
    mean over the last ``bars`` times, wildest and calmest symbol."""
    known = volatility.where(F.col(value).isNotNull()).select("symbol", "open_time", F.col(value).alias("v"))
    each = known.groupBy("open_time").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.max_by("symbol", "v").alias("wildest"), F.min_by("symbol", "v").alias("calmest"))
    recent = each.orderBy(F.desc("open_time")).limit(bars)
    last = recent.agg(F.max_by(F.struct("open_time", "n", "mean", "sd", "wildest", "calmest"), "open_time").alias("x"), F.min_by("mean", "open_time").alias("first_mean"))
    pairs = paired(known.join(F.broadcast(recent.select("open_time")), "open_time")).groupBy("symbol_a", "symbol_b").agg(safe_corr("v_a", "v_b").alias("corr"))
    return last.crossJoin(pairs.agg(F.avg("corr").alias("pair_corr"))).select("x.*", (F.try_divide("x.mean", "first_mean") - 1).alias("change"), "pair_corr")


# --- pairs of series


def left_aligned(bars: DataFrame, base: str) -> DataFrame:
    """symbol, open_time, close at the times of symbol ``base``, the last close of each other symbol carried on."""
    times = bars.where(F.col("symbol") == base).select("open_time").distinct()
    slots = bars.select("symbol").distinct().crossJoin(times)  # a few symbols by the bars of one
    closes = bars.select("symbol", "open_time", "close")
    joined = slots.join(closes, ["symbol", "open_time"], "left")
    return joined.withColumn("close", F.last("close", True).over(order().rowsBetween(Window.unboundedPreceding, 0)))


def inversions(x: np.ndarray) -> int:
    """Pairs i < j with x[i] > x[j], by merging."""
    if len(x) < 2:
        return 0
    half = len(x) // 2
    a, b = x[:half], x[half:]
    return inversions(a) + inversions(b) + int((len(a) - np.searchsorted(np.sort(a), b, "right")).sum())


def kendall(bars: DataFrame) -> DataFrame:
    """symbol_a, symbol_b, n, tau: rank correlation of closes at common times by agreeing and opposed pairs, ties accounted
    for; in n log n by counting inversions."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["close_a", "close_b"])
        n, tied = len(rows), lambda *c: int((rows.groupby(list(c)).size().pipe(lambda s: s * (s - 1) // 2)).sum())
        pairs, ta, tb, both = n * (n - 1) // 2, tied("close_a"), tied("close_b"), tied("close_a", "close_b")
        opposed = inversions(rows["close_b"].to_numpy())
        spread = np.sqrt(float(pairs - ta) * float(pairs - tb))
        tau = (pairs - ta - tb + both - 2 * opposed) / spread if spread else None
        return pd.DataFrame({"symbol_a": [rows["symbol_a"].iloc[0]], "symbol_b": [rows["symbol_b"].iloc[0]], "n": [n], "tau": [tau]})

    pairs = paired(bars.select("symbol", "open_time", "close")).dropna()
    return pairs.groupBy("symbol_a", "symbol_b").applyInPandas(run, "symbol_a string, symbol_b string, n long, tau double")


def winsorised(bars: DataFrame, column: str = "volume", deviations: float = 3.0) -> DataFrame:
    """Values beyond the mean by so many deviations become their symbol's median."""
    stats = bars.groupBy("symbol").agg((F.avg(column) + deviations * F.stddev_samp(column)).alias("_hi"), F.percentile(column, 0.5).alias("_mid"))
    return bars.join(stats, "symbol").withColumn(column, F.when(F.col(column) > F.col("_hi"), F.col("_mid")).otherwise(F.col(column))).drop("_hi", "_mid")


def pair_correlation(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, symbol_a, symbol_b, n, corr of one column at common times."""
    pairs = paired(rows.select("symbol", "open_time", *by, value))
    pairs = pairs.withColumns({c: F.col(f"{c}_a") for c in by})
    return pairs.groupBy(*by, "symbol_a", "symbol_b").agg(F.count("*").alias("n"), safe_corr(f"{value}_a", f"{value}_b").alias("corr"))


def strong_pairs(matrix: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs with a correlation of at least ``least``, or at most its negative, with kind."""
    kind = F.when(F.col("corr") >= least, "together").when(F.col("corr") <= -least, "opposed")
    return matrix.withColumn("kind", kind).where("kind is not null")


def static_beta(bars: DataFrame, market: str) -> DataFrame:
    """symbol, n, beta, alpha, r2 of the regression of each symbol's returns on those of symbol ``market``."""
    ret = measures(bars).select("symbol", "open_time", "ret").where("ret is not null")
    base = ret.where(F.col("symbol") == market).select("open_time", F.col("ret").alias("x"))
    return ret.where(F.col("symbol") != market).join(base, "open_time").groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("ret", "x").alias("beta"), F.regr_intercept("ret", "x").alias("alpha"), F.regr_r2("ret", "x").alias("r2"))


def regime_correlations(bars: DataFrame, regimes: DataFrame) -> DataFrame:
    """regime, symbol_a, symbol_b, n and the correlations of price, volume, returns and volatility at the times of each
    regime; ``regimes`` has open_time and regime, of one symbol or a market."""
    pairs = paired(measures(bars)).join(regimes.select("open_time", "regime"), "open_time")
    made: dict[str, Column] = {f"corr_{m}": safe_corr(f"{m}_a", f"{m}_b") for m in ("price", "volume", "ret", "vol")}
    return pairs.groupBy("regime", "symbol_a", "symbol_b").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in made.items()])
