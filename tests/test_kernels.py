"""Recursive kernels and model statistics against direct formulas, streams against batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlery.operators import joins, models, recursive
from candlery.sources.candles import EVENTS, candles
from candlery.streaming import candle_stream


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(4)
    close = 100 + np.cumsum(rng.normal(0, 1, 120))
    return close + rng.uniform(0, 1, 120), close - rng.uniform(0, 1, 120), close


def test_exponential_means(walk):
    close = walk[2]
    for adjust in (True, False):
        expected = pd.Series(close).ewm(alpha=0.2, adjust=adjust).mean().to_numpy()
        assert np.allclose(recursive.ewm_mean(close, 0.2, adjust), expected)
    seeded = recursive.seeded_ema(close, 10)
    assert np.isnan(seeded[:9]).all() and seeded[9] == pytest.approx(close[:10].mean())
    assert seeded[10] == pytest.approx(seeded[9] + 2 / 11 * (close[10] - seeded[9]))
    assert np.isnan(recursive.seeded_ema(close[:5], 10)).all()


def test_rsi_and_bands(walk):
    high, low, close = walk
    assert recursive.rsi(np.arange(1.0, 40.0), 14)[-1] == 100
    assert recursive.rsi(np.arange(40.0, 1.0, -1), 14)[-1] == 0
    line, side = recursive.supertrend(high, low, close)
    known = ~np.isnan(side)
    assert set(side[known]) <= {1.0, -1.0} and (np.where(side[known] == 1, close[known] >= line[known], close[known] <= line[known])).all()
    sar = recursive.parabolic_sar(np.arange(2.0, 30.0), np.arange(1.0, 29.0))
    assert (sar[1:] <= np.arange(1.0, 29.0)[1:]).all() and (np.diff(sar[1:]) >= 0).all()


def test_statistics():
    rng = np.random.default_rng(9)
    noise, path = rng.normal(size=600), np.cumsum(rng.normal(size=600) + 0.5)
    assert models.adf(noise) < -10 and models.adf(path) > -2.86 and models.kpss(noise) < 0.463 and models.kpss(path) > 0.739
    ar = np.zeros(3000)
    for i in range(1, 3000):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    beta, rest, _ = models.fit_arma(ar, 1, 0)
    assert beta[1] == pytest.approx(0.7, abs=0.05) and rest.std() == pytest.approx(1, abs=0.05)
    assert models.pacf(ar, 3)[0] == pytest.approx(0.7, abs=0.05) and abs(models.pacf(ar, 3)[1]) < 0.06
    assert models.chi2_tail(3.841, 1) == pytest.approx(0.05, abs=1e-3) and models.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-3)
    assert np.isnan(models.adf(np.ones(50))) and np.isnan(models.kpss(np.ones(3)))


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, name string, v double")
    news = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "k long, name string, v double")
    full = {tuple(r) for r in joins.upserted(stored, news, ["k"]).collect()}
    part = {tuple(r) for r in joins.upserted(stored, news, ["k"], partial=True).collect()}
    assert full == {(1, "a", 1.0), (2, None, 5.0), (3, "c", None)} and part == {(1, "a", 1.0), (2, "b", 5.0), (3, "c", None)}


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    folder = str(tmp_path_factory.mktemp("ticks"))
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 5 * 86_400, 2_000)), unit="s")
    rows = pd.DataFrame({"event_id": range(2_000), "ts": at, "event_type": rng.choice(["a", "b"], 2_000), "value": rng.uniform(1, 9, 2_000)})
    for k in range(4):
        part = pd.concat([rows.iloc[k * 500 : (k + 1) * 500], rows.iloc[k * 500 : k * 500 + 5]])  # some ticks come twice
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def test_streamed_candles_equal_batch(spark, ticks, tmp_path):
    folder, rows = ticks
    schema = spark.read.parquet(folder).schema.simpleString()[7:-1].replace(":", " ")
    stream = candle_stream.stream_candles(candle_stream.tick_source(spark, folder, schema, 4), "event_type", "ts", "value", "event_id", lateness="10 days")
    query = stream.writeStream.outputMode("update").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("bars").select("symbol", F.col("open_time").cast("string"), "open", "high", "low", "close", "volume").collect()}
    batch = candles(spark.createDataFrame(rows), width="4 hours", **EVENTS)
    assert got == {tuple(r) for r in batch.select("symbol", F.col("open_time").cast("string"), "open", "high", "low", "close", "volume").collect()}


def test_streamed_signals_equal_a_fold(spark, ticks, tmp_path):
    _, rows = ticks
    bars = candles(spark.createDataFrame(rows), width="4 hours", **EVENTS).orderBy("open_time").toPandas()
    folder = str(tmp_path / "bars")
    for part in (bars.iloc[:20], bars.iloc[18:45], bars.iloc[45:]):  # two bars arrive again
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = candle_stream.stream_signals(stream).writeStream.outputMode("append").format("memory").queryName("signals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("signals").toPandas().sort_values(["symbol", "open_time"])
    assert len(got) == len(bars)
    for symbol, mine in bars.groupby("symbol"):
        state = dict.fromkeys([c.split()[0] for c in candle_stream.STATE.split(", ")], 0.0) | {"count": 0}
        for bar, seen in zip(mine.itertuples(), got[got.symbol == symbol].itertuples(), strict=True):
            state = candle_stream.step(state, bar.close, (bar.high + bar.low + bar.close) / 3, bar.volume)
            ema, _, vwap, signal = candle_stream.signal_row(state)
            assert seen.ema == pytest.approx(ema) and seen.vwap == pytest.approx(vwap) and seen.signal == signal
