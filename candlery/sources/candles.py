"""Candles from ticks: the bridge from raw event tables to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candles(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, width: str) -> DataFrame:
    """symbol, open_time, open, high, low, close, volume (ticks) of every non-empty bar of ``width``, such as '4 hours'.

    First and last are those by (ts, tie), not by row order. Combined before the shuffle: however many ticks a symbol
    has, a bar is one row per task. Everything later works on bars, whose number per symbol the calendar bounds.
    """
    at = F.struct(ts, tie)
    return (
        ticks.where(F.col(ts).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def candles_sql(table: str, symbol: str, ts: str, price: str, tie: str, width: str) -> str:
    """The DuckDB twin of candles()."""
    return f"""select {symbol} as symbol, time_bucket(interval '{width}', {ts}) as open_time, first({price} order by {ts}, {tie}) as open,
        max({price}) as high, min({price}) as low, last({price} order by {ts}, {tie}) as close, cast(count(*) as double) as volume
        from {table} where {ts} is not null group by 1, 2"""


EVENTS = {"symbol": "event_type", "ts": "ts", "price": "value", "tie": "event_id"}
ORDERS = {"symbol": "o_orderpriority", "ts": "o_orderdate", "price": "o_totalprice", "tie": "o_orderkey"}
