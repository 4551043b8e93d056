"""Queries of the operators over candles: four-hour bars of the events, daily bars of the orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators.bars import latest_bars
from candlery.operators.features import CATALOG
from candlery.sources.candles import EVENTS, ORDERS, candles, candles_sql
from candlery.plans.twins import TWINS, twin
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: Catalogue entries that are also run over daily bars.
DAILY = ("w04_calendar", "v01_volatility", "y04_market_phase", "y05_bull_bear", "g05_stationary")


def four_hours(spark: SparkSession, folder: str) -> DataFrame:
    return candles(table(spark, folder, "events"), width="4 hours", **EVENTS)


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return candles(table(spark, folder, "orders"), width="1 day", **ORDERS)


FOUR_HOURS_SQL = candles_sql("events", width="4 hours", **EVENTS)
DAILY_SQL = candles_sql("orders", width="1 day", **ORDERS)


#: Catalogue entries that are also run over the delivered bars of every feed and timeframe, and how far they look.
REACH = {"w01_lagged": 14, "t01_sma": 200, "t03_rsi_simple": 15, "t05_bollinger": 20, "t06_stochastic": 18, "k01_candle_patterns": 20, "v01_volatility": 55}


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """feed_id, tf, per, open_time and prices of btc_klines; bars that miss a price or volume are left out."""
    rows = latest_bars(table(spark, folder, "btc_klines"), "open", "high", "low", "close", "volume").where("least(open, high, low, close) > 0 and volume is not null and close is not null and open is not null and high is not null and low is not null")
    return rows.withColumn("open_time", F.timestamp_add("SECOND", F.col("per") * F.col("tf"), F.expr("timestamp_ntz'1970-01-01 00:00:00'")))


def over_delivered(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        made = CATALOG[name].apply_blocked(delivered(spark, folder), REACH[name])
        return made.withColumn("symbol", F.concat_ws("|", "feed_id", F.col("tf").cast("string"))).drop("feed_id", "tf")

    return run


def delivered_sql() -> str:
    from candlery.plans.data_queries import BARS_SQL

    known = " and ".join(f"{c} is not null" for c in ("open", "high", "low", "close", "volume"))
    return f"with {BARS_SQL} select feed_id || '|' || tf as symbol, make_timestamp(cast(per * tf * 1000000 as bigint)) as open_time, open, high, low, close, volume from counting where {known} and least(open, high, low, close) > 0"


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f"{name}": lambda s, d, p=plan: p.apply(four_hours(s, d)) for name, plan in CATALOG.items()}
    found |= {f"{name}_daily": lambda s, d, p=CATALOG[name]: p.apply(daily(s, d)) for name in DAILY}
    found |= {f"{name}_delivered": over_delivered(name) for name in REACH}
    return found | {"s01_candles": four_hours, "s02_daily_bars": daily}


def oracle_sql() -> dict[str, str]:
    own = lambda name, bars: twin(name, bars) if name in TWINS else CATALOG[name].sql(bars)
    found = {name: own(name, FOUR_HOURS_SQL) for name in CATALOG} | {f"{name}_daily": own(name, DAILY_SQL) for name in DAILY}
    found |= {f"{name}_delivered": twin(name, delivered_sql()) for name in REACH}
    return found | {"s01_candles": FOUR_HOURS_SQL, "s02_daily_bars": DAILY_SQL}
