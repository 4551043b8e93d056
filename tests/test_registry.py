"""Registry, pipelines, kline messages, levels and clusters on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from candlery.operators import joins, learning, pipeline
from candlery.operators.registry import Registry, analysis_json, parsed_klines, window_slices

BARS = "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def bars(spark):
    rows = [("a", f"2024-01-{1 + i // 6:02d} {i % 6 * 4:02d}:00:00", 10.0 + i % 5, 12.0 + i % 5, 9.0 + i % 5, 11.0 + i % 5, 3.0) for i in range(60)]
    return spark.createDataFrame(rows, BARS.replace("timestamp_ntz", "string")).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


def test_registry(spark, tmp_path):
    store = Registry(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "symbol_a string, symbol_b string, kind string, timeframe string, corr double")
    store.save("correlation_pairs", rows(("a", "b", "price", "1d", 0.2), ("a", "c", "price", "1d", -0.9)), 1)
    store.save("correlation_pairs", rows(("a", "b", "price", "1d", 0.5)), 2)
    store.save("correlation_pairs", rows(("a", "b", "price", "1d", 0.6)), 2)
    assert {(r.symbol_b, r["corr"]) for r in store.latest("correlation_pairs").collect()} == {("b", 0.6), ("c", -0.9)}
    assert [r.symbol_b for r in store.top_pairs(1).collect()] == ["c"]
    assert store.latest("correlation_pairs", symbol_b="b").count() == 1 and store.history("correlation_pairs").count() == 3
    with pytest.raises(ValueError, match="needs the columns"):
        store.save("predictions", rows(("a", "b", "price", "1d", 0.6)), 1)


def test_pipeline(spark, bars):
    out = pipeline.run_steps(bars.union(bars), ["drop_duplicates", ("time_range", {"start": "2024-01-02", "end": "2024-01-09"}), "repair", ("features", {"groups": ("w01_lagged", "w08_returns")})])
    assert out.count() == out.select("symbol", "open_time").distinct().count() > 30
    assert {"close_lag_1", "return_1p", "target_return"} <= set(out.columns)
    with pytest.raises(ValueError, match="unknown steps"):
        pipeline.run_steps(bars, ["no such step"])


def test_kline_messages(spark):
    k = {"t": 1704067200000, "T": 1704070799999, "i": "1h", "o": "1.5", "c": "x", "h": "2", "l": "1", "v": "3", "n": 7, "x": True, "q": "4", "V": "1", "Q": "2"}
    messages = spark.createDataFrame([(json.dumps({"e": "kline", "s": "BTC", "k": k}),), ("{broken",), (None,), ("{}",)], "json string")
    (row,) = parsed_klines(messages).collect()
    assert (row.symbol, row.open, row.close, row.number_of_trades, row.is_closed) == ("BTC", 1.5, None, 7, True)


def test_slices_cover_without_overlap(spark):
    rows = window_slices(spark, "2024-01-01 00:00:00", "2024-01-25 12:00:00", "10 days").orderBy("slice_start").collect()
    assert [str(r.slice_start)[:10] for r in rows] == ["2024-01-01", "2024-01-11", "2024-01-21"]
    assert all(a.slice_end == b.slice_start for a, b in zip(rows, rows[1:], strict=False)) and str(rows[-1].slice_end) == "2024-01-25 12:00:00"


def test_asof_and_levels(spark, bars):
    events = spark.createDataFrame([("a", "2024-01-03 00:00:00", "x"), ("a", "2024-01-05 02:00:00", "y")], "symbol string, at string, name string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    out = joins.asof(bars, events, ["symbol"], "open_time", "at", ["name"]).orderBy("open_time").collect()
    expected = [("x" if str(r.open_time) >= "2024-01-03" else None) if str(r.open_time) < "2024-01-05 02" else "y" for r in out]
    assert [r.prev_name for r in out] == expected and out[0].next_name == "x" and out[-1].next_name is None
    assert learning.price_levels(bars, reach=2).where("kind = 'resistance' and touches >= 3").count() >= 1
    cut = analysis_json(spark.createDataFrame([(1, "x" * 900)], "doc_id long, text string"), "text").first().json
    assert len(json.loads(cut)["text"]) == 500


def test_news_clusters_in_parts(spark):
    rows = [(i, f"bitcoin treasury report number{i % 3} volume spread market", "2024-01-01 10:00:00", None) for i in range(30)] + [(99, None, "2024-01-01 10:00:00", "en"), (100, "x", None, "en")]
    items = spark.createDataFrame(rows, "doc_id long, text string, published_at string, lang string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    out = learning.news_clusters(items, most=10).collect()
    assert len(out) == 31 and {r.part for r in out if r.doc_id < 50} == {0, 1, 2}
