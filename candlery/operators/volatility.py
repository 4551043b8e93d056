"""The whole volatility analysis of many symbols, and phases of a market by its volatility."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlery.operators import correlation, models, seasonality
from candlery.operators.features import CATALOG

#: Phases from the calmest to the wildest.
PHASES = ("quiet", "steady", "active", "turbulent")


def full_analysis(bars: DataFrame, fitted: bool = True) -> DataFrame:
    """One row per symbol: bars, mean and last value of each estimator, breakouts, risk (as in seasonality.risk), the first
    autocorrelation of squared returns and, if ``fitted``, the persistence and half-life of a GARCH(1,1)."""
    rows = CATALOG["v01_volatility"].apply(bars)
    names = ("hist_vol_14", "parkinson_14", "garman_klass_14", "yang_zhang_14")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("open_time"))
    found = rows.groupBy("symbol").agg(
        F.count("*").alias("bars"), *[F.avg(c).alias(f"{c}_mean") for c in names], *[F.max_by(c, known(c)).alias(f"{c}_last") for c in names], F.sum("vol_breakout").alias("breakouts")
    )
    found = found.join(seasonality.risk(bars), "symbol", "left")
    clustering = correlation.autocorrelation(bars).where("lag_bars = 1").select("symbol", F.col("acf").alias("clustering"))
    found = found.join(clustering, "symbol", "left")
    return found.join(models.garch(bars).select("symbol", "persistence", "half_life"), "symbol", "left") if fitted else found


def market_phases(volatility: DataFrame, value: str = "hist_vol_14", lookback: int = 30, k: int = 4, seed: int = 42) -> DataFrame:
    """open_time, mean, dispersion, trend, phase: k-means of the market's mean volatility, its spread over symbols and its
    change over ``lookback`` times, phases named by the mean of their centre. One row a time."""
    each = volatility.where(F.col(value).isNotNull()).groupBy("open_time").agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("dispersion"))
    w = Window.orderBy("open_time")  # one row a time
    rows = each.withColumn("trend", F.try_divide("mean", F.lag("mean", lookback).over(w)) - 1).where("trend is not null")
    packed = VectorAssembler(inputCols=["mean", "dispersion", "trend"], outputCol="raw").transform(rows)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(packed).transform(packed)
    labelled = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(scaled).transform(scaled)
    centres = labelled.groupBy("cluster").agg(F.avg("mean").alias("centre"))
    names = F.array(*map(F.lit, PHASES[:k]))
    ranked = centres.withColumn("phase", F.element_at(names, F.row_number().over(Window.orderBy("centre"))))  # k rows
    return labelled.join(F.broadcast(ranked), "cluster").select("open_time", "mean", "dispersion", "trend", "phase")
