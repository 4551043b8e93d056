"""Streams: ticks to candles, duplicates and late rows, and indicators with state kept per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "count long, total double, gain double, loss double, ema double, last_close double, turnover double, volume double, last_us long, open_close double, open_typical double, open_volume double"
SIGNALS = "symbol string, open_time timestamp, close double, ema double, rsi double, vwap double, signal long"
#: Length of the exponential means that a symbol's state carries.
SPAN, WILDER = 20, 14


def tick_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_candles(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, width: str = "4 hours", lateness: str = "10 minutes") -> DataFrame:
    """Candles of a tick stream by event time; ticks later than the watermark are dropped, repeated ones count once.

    The same aggregates as the batch candles, so a complete stream gives the batch result.
    """
    seen = ticks.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([tie])
    at = F.struct(ts, tie)
    bars = seen.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume")


def step(state: dict, close: float, typical: float, volume: float) -> dict:
    """One bar further: exponential mean, Wilder gains and losses, session price. Pure, so batch and stream agree."""
    n = state["count"] + 1
    ema = close if n == 1 else state["ema"] + 2 / (SPAN + 1) * (close - state["ema"])
    move = 0.0 if n == 1 else close - state["last_close"]
    a = 1 / min(max(n - 1, 1), WILDER)
    return state | {
        "count": n, "total": state["total"] + close, "ema": ema, "gain": state["gain"] + a * (max(move, 0) - state["gain"]), "loss": state["loss"] + a * (max(-move, 0) - state["loss"]),
        "last_close": close, "turnover": state["turnover"] + typical * volume, "volume": state["volume"] + volume,
    }


def signal_row(state: dict) -> tuple[float, float | None, float | None, int]:
    """ema, rsi, vwap and the majority of their votes (1 buy, -1 sell)."""
    moves = state["gain"] + state["loss"]
    rsi = 100 * state["gain"] / moves if moves else None
    vwap = state["turnover"] / state["volume"] if state["volume"] else None
    votes = (state["last_close"] > state["ema"]) - (state["last_close"] < state["ema"])
    votes += 0 if rsi is None else (rsi < 30) - (rsi > 70)
    votes += 0 if vwap is None else (state["last_close"] > vwap) - (state["last_close"] < vwap)
    return state["ema"], rsi, vwap, (votes > 0) - (votes < 0)


def _update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in STATE.split(", ")]
    # the state before the newest bar, and that bar: it may be corrected until the next one begins
    state = dict(zip(names, held.get, strict=True)) if held.exists else dict.fromkeys(names, 0.0) | {"count": 0, "last_us": -(2**62)}
    bars = pd.concat(list(batches)).sort_values("open_time", kind="stable").drop_duplicates("open_time", keep="last")
    rows = []
    for bar in bars.itertuples():
        at = bar.open_time.value // 1000
        if at < state["last_us"]:  # a closed bar stays as it was
            continue
        values = {"open_close": bar.close, "open_typical": (bar.high + bar.low + bar.close) / 3, "open_volume": bar.volume}
        if at == state["last_us"] and all(state[k] == v for k, v in values.items()):
            continue
        if at > state["last_us"] and state["last_us"] > -(2**62):
            state = step(state, state["open_close"], state["open_typical"], state["open_volume"])
        state |= values | {"last_us": at}
        now = step(state, state["open_close"], state["open_typical"], state["open_volume"])
        rows.append((key[0], bar.open_time, bar.close, *signal_row(now)))
    held.update(tuple(int(state[n]) if n in ("count", "last_us") else float(state[n]) for n in names))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNALS.split(", ")])


def stream_signals(bars: DataFrame) -> DataFrame:
    """Signals of a stream of bars, one row each time a bar arrives: the newest bar of a symbol is taken anew until a later
    one begins; bars before it, and bars as they were, change nothing."""
    return bars.withColumn("open_time", F.col("open_time").cast("timestamp")).groupBy("symbol").applyInPandasWithState(_update, SIGNALS, STATE, "append", GroupStateTimeout.NoTimeout)


def newest_version(spark: SparkSession, folder: str, below: int) -> str | None:
    """Path of the last table under ``folder`` written whole by a batch before ``below``; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [x.getPath().getName() for x in files.listStatus(path)]
    for number in sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) < below), reverse=True):
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v{number}/_SUCCESS")):
            return f"{folder}/v{number}"
    return None


def merge_batch(batch: DataFrame, number: int, folder: str, keys: list[str], version: str) -> None:
    """Merge a batch with the newest whole table before it and write the outcome beside it. A read that fails raises."""
    from candlery.operators.joins import latest_versions

    before = newest_version(batch.sparkSession, folder, number)
    rows = batch if before is None else batch.sparkSession.read.parquet(before).unionByName(batch)
    latest_versions(rows, keys, [version]).write.mode("overwrite").parquet(f"{folder}/v{number}")


def upsert_sink(stream: DataFrame, folder: str, keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Keeps the latest version of each key in a folder of Parquet tables, one per batch.

    A batch is merged with the newest whole table and written beside it, so a failed batch leaves the old one whole, and a
    batch that is run again gives the same table.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, folder, keys, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
