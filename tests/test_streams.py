"""Streams that lose nothing: upserts after failed reads, bars corrected until they close."""

import shutil
from datetime import datetime, timedelta

import pytest

from candlery.operators import joins
from candlery.streaming import candle_stream

T0 = datetime(2024, 1, 1)


def test_upsert_keeps_all_rows_when_a_read_fails(spark, tmp_path):
    folder = str(tmp_path / "table")
    batch = lambda rows: spark.createDataFrame(rows, "k long, v string, at long")
    candle_stream.merge_batch(batch([(1, "a", 1), (2, "b", 1)]), 0, folder, ["k"], "at")
    part = next((tmp_path / "table" / "v0").glob("*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017, PT011
        candle_stream.merge_batch(batch([(3, "c", 1)]), 1, folder, ["k"], "at")
    part.write_bytes(whole)
    (tmp_path / "table" / "v0" / f".{part.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "table" / "v1", ignore_errors=True)
    candle_stream.merge_batch(batch([(3, "c", 1), (2, "bb", 2)]), 1, folder, ["k"], "at")
    assert candle_stream.newest_version(spark, folder, 9).endswith("v1")
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/v1").select("k", "v").collect())) == [(1, "a"), (2, "bb"), (3, "c")]


def test_upsert_sink_over_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(k % 2, f"v{k}", k)], "k long, v string, at long").coalesce(1).write.mode("append").parquet(source)
    stream = candle_stream.tick_source(spark, source, "k long, v string, at long")
    candle_stream.upsert_sink(stream, folder, ["k"], "at", str(tmp_path / "c")).awaitTermination()
    newest = candle_stream.newest_version(spark, folder, 99)
    assert sorted(map(tuple, spark.read.parquet(newest).select("k", "v").collect())) == [(0, "v2"), (1, "v1")]


def test_an_open_bar_is_corrected(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "symbol string, open_time timestamp, high double, low double, close double, volume double"
    arrivals = [(0, 10.0), (1, 11.0), (1, 12.0), (2, 9.0), (1, 99.0)]
    for hour, close in arrivals:
        spark.createDataFrame([("a", T0 + timedelta(hours=hour), close, close, close, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = candle_stream.stream_signals(candle_stream.tick_source(spark, source, schema))
    query = stream.writeStream.outputMode("append").format("memory").queryName("corrected").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("corrected").collect()
    assert sorted(r.close for r in rows) == [9.0, 10.0, 11.0, 12.0]
    alpha = 2 / (candle_stream.SPAN + 1)
    ema = 10 + alpha * (12 - 10)
    ema += alpha * (9 - ema)
    assert abs(next(r.ema for r in rows if r.close == 9.0) - ema) < 1e-9


def test_upsert_of_repeated_incoming_keys_takes_the_latest(spark):
    stored = spark.createDataFrame([(1, "old", 0)], "k long, v string, at long")
    news = spark.createDataFrame([(1, "z first", 1), (1, "a second", 2), (2, None, 3)], "k long, v string, at long")
    assert sorted(map(tuple, joins.upserted(stored, news, ["k"], version=["at"]).collect())) == [(1, "a second", 2), (2, None, 3)]
    assert sorted(map(tuple, joins.upserted(stored, news, ["k"], partial=True, version=["at"]).collect())) == [(1, "a second", 2), (2, None, 3)]
