"""Results saved in versions and read back, and the whole volatility analysis, with DuckDB twins written apart from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators import models, summaries, volatility
from candlery.operators.features import CATALOG
from candlery.operators.registry import Registry
from candlery.plans.candle_queries import FOUR_HOURS_SQL, four_hours
from candlery.plans.relation_queries import A06_SQL, A09_SQL, L05_SQL, V09_SQL, a09_cycle_table
from candlery.plans.summary_queries import FC, X05_SQL, X12_SQL, _forecasts, _rounded, x12_regime_correlations
from candlery.plans.trend_queries import R24_SQL, r24_trend_summary
from candlery.plans.twins import twin
from candlery.session import ensure_checkpoint_dir
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def registry(spark: SparkSession) -> Registry:
    """A registry of its own in the shared folder."""
    ensure_checkpoint_dir(spark)
    return Registry(spark, f"{spark.sparkContext.getCheckpointDir()}/registry-{uuid.uuid4().hex}")


def _saved(spark: SparkSession, name: str, rows: DataFrame, spoiled: str) -> DataFrame:
    """Rows saved twice, the first time with one column emptied: what is read back is the second version."""
    stored = registry(spark)
    stored.save(name, rows.withColumn(spoiled, F.lit(None).cast(rows.schema[spoiled].dataType)), 1)
    stored.save(name, rows, 2)
    return stored.latest(name).select(*rows.columns)


def s13_stored_sequences(spark: SparkSession, folder: str) -> DataFrame:
    rows = models.sequences(four_hours(spark, folder), ["close", "volume"]).withColumn("timeframe", F.lit("4h"))
    return _saved(spark, "sequences", rows, "close")


def s20_stored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    from candlery.operators.correlation import measures

    pairs = summaries.pair_correlation(measures(four_hours(spark, folder)).where("ret is not null"), "ret")
    return _rounded(_saved(spark, "correlation_pairs", pairs.withColumns({"kind": F.lit("ret"), "timeframe": F.lit("4h")}), "corr"))


def s20_stored_regimes(spark: SparkSession, folder: str) -> DataFrame:
    return _saved(spark, "regime_correlations", x12_regime_correlations(spark, folder), "corr_price")


def s21_stored_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return _saved(spark, "market_cycles", a09_cycle_table(spark, folder), "roi")


def s22_stored_volatility(spark: SparkSession, folder: str) -> DataFrame:
    rows = CATALOG["v01_volatility"].apply(four_hours(spark, folder)).withColumn("timeframe", F.lit("4h"))
    return _saved(spark, "volatility_metrics", rows, "hist_vol_14")


def s23_stored_trends(spark: SparkSession, folder: str) -> DataFrame:
    return _saved(spark, "trend_analysis", r24_trend_summary(spark, folder).withColumn("timeframe", F.lit("4h")), "trend")


def s24_stored_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Each link with the highest id, score and title that came with it."""
    items = table(spark, folder, "news_items").where("link is not null").groupBy("link").agg(F.max("news_id").alias("news_id"), F.max("score").alias("score"), F.max("title").alias("title"))
    return _saved(spark, "news_articles", items, "title")


def s25_scored_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions stored before their time, and their errors once the close is known."""
    rows = _forecasts(spark, folder).select(F.col("model").alias("model_key"), "symbol", F.lit("4h").alias("timeframe"), F.col("open_time").alias("target_at"), F.col("forecast").alias("predicted"))
    stored = registry(spark)
    stored.save("predictions", rows, 1)
    actual = four_hours(spark, folder).select("symbol", F.col("open_time").alias("target_at"), F.col("close").alias("actual"))
    return _rounded(stored.with_actuals(actual).select("model_key", "symbol", "target_at", "predicted", "actual", "abs_error"), 8)


def g18_stored_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of every model in long form, saved in two versions."""
    made = summaries.forecast_accuracy(_forecasts(spark, folder), four_hours(spark, folder), ("model",))
    long = made.unpivot("model", ["rmse", "mae", "r2"], "metric", "value").select(F.col("model").alias("model_key"), "metric", F.lit("2024-02-01").alias("test_date"), "value")
    return _rounded(_saved(spark, "model_metrics", long, "value"), 4)


def v17_full_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(volatility.full_analysis(four_hours(spark, folder), fitted=False), 5)


def v17_fitted_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return volatility.full_analysis(four_hours(spark, folder))


def v08_market_phases(spark: SparkSession, folder: str) -> DataFrame:
    return volatility.market_phases(CATALOG["v01_volatility"].apply(four_hours(spark, folder)))


_NAMES = ("hist_vol_14", "parkinson_14", "garman_klass_14", "yang_zhang_14")
V17_SQL = f"""with v as ({twin("v01_volatility", FOUR_HOURS_SQL)}), g as (select symbol, count(*) as bars, {", ".join(f"round(avg({c}), 5) as {c}_mean" for c in _NAMES)}, {", ".join(f"round(arg_max({c}, open_time) filter ({c} is not null), 5) as {c}_last" for c in _NAMES)}, cast(sum(vol_breakout) as bigint) as breakouts from v group by 1)
 select g.*, round(r.var_95, 5) as var_95, round(r.var_99, 5) as var_99, round(r.cvar_95, 5) as cvar_95, round(r.cvar_99, 5) as cvar_99, round(r.sharpe, 5) as sharpe, round(r.max_drawdown, 5) as max_drawdown, round(c.acf, 5) as clustering
 from g left join ({A06_SQL}) r using (symbol) left join ({V09_SQL}) c on c.symbol = g.symbol and c.lag_bars = 1"""
TWINS = {
    "s13_stored_sequences": f"select *, '4h' as timeframe from ({L05_SQL})", "s20_stored_pairs": f"select symbol_a, symbol_b, n, corr, 'ret' as kind, '4h' as timeframe from ({X05_SQL.split(', case when corr > 0')[0]} from z)",
    "s20_stored_regimes": X12_SQL, "s21_stored_cycles": A09_SQL, "s22_stored_volatility": f"select *, '4h' as timeframe from ({twin('v01_volatility', FOUR_HOURS_SQL)})", "s23_stored_trends": f"select *, '4h' as timeframe from ({R24_SQL})",
    "s24_stored_articles": "select link, max(news_id) as news_id, max(score) as score, max(title) as title from news_items where link is not null group by 1",
    "s25_scored_predictions": f"with {FC} select model as model_key, symbol, open_time as target_at, round(forecast, 8) as predicted, round(actual, 8) as actual, round(abs(forecast - actual), 8) as abs_error from f",
    "g18_stored_metrics": f"""with {FC}, m as (select model, sqrt(avg(pow(actual - forecast, 2))) as rmse, avg(abs(actual - forecast)) as mae, 1 - sum(pow(actual - forecast, 2)) / nullif(var_pop(actual) * count(*), 0) as r2 from f group by 1)
 select model as model_key, metric, '2024-02-01' as test_date, round(value, 4) as value from (unpivot m on rmse, mae, r2 into name metric value value)""",
    "v17_full_volatility": V17_SQL, "v17_fitted_volatility": "", "v08_market_phases": "",
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in TWINS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in TWINS.items() if sql}
