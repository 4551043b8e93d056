"""Cleaning, resampling, trends, transforms and stores on small frames: awkward input, published numbers, unknown names."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlery.operators import cleaning, cycles, learning, models, resampling, summaries, transforms, trend
from candlery.operators.features import CATALOG
from candlery.operators.registry import Registry
from candlery.sources import loading

T0 = datetime(2024, 1, 1)
SCHEMA = "symbol string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="a", timeframe="1h", hours=1):
    rows = [(symbol, timeframe, T0 + timedelta(hours=hours * i), *([None] * 4 if c is None else [c, c + 1, c - 1, c]), 1.0 + i % 3) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_two_timeframes_of_one_symbol_stay_apart(spark):
    rng = np.random.default_rng(1)
    hourly, daily = bars(spark, (100 + rng.normal(0, 1, 40)).tolist()), bars(spark, (900 + rng.normal(0, 9, 40)).tolist(), timeframe="1d", hours=24)
    both = {}
    for name in ("t01_sma", "t05_bollinger", "v01_volatility", "w08_returns"):
        alone = {tuple(r) for part in (hourly, daily) for r in CATALOG[name].apply(part, ("symbol", "timeframe")).collect()}
        both[name] = {tuple(r) for r in CATALOG[name].apply(hourly.union(daily), ("symbol", "timeframe")).collect()}
        assert both[name] == alone and len(alone) == 80


def test_fills(spark):
    rows = bars(spark, [None, 1.0, None, None, 4.0, None])
    close = lambda df: [r.close for r in df.orderBy("open_time").collect()]
    keys = ["symbol", "timeframe"]
    assert close(cleaning.filled(rows, keys, "open_time", ["close"])) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert close(cleaning.filled(rows, keys, "open_time", ["close"], "ffill")) == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert close(cleaning.filled(rows, keys, "open_time", ["close"], "ffill", 1)) == [None, 1.0, 1.0, None, 4.0, 4.0]
    assert close(cleaning.filled(rows, keys, "open_time", ["close"], "mean")) == [2.5, 1.0, 2.5, 2.5, 4.0, 2.5]
    with pytest.raises(ValueError, match="unknown method"):
        cleaning.filled(rows, keys, "open_time", ["close"], "guess")


def test_repairs_in_order(spark):
    rows = [(-5.0, 10.0, 9.0, 9.5, 2.0), (9.0, 0.0, 8.0, 9.5, -1.0), (9.0, 10.0, 0.0, 9.5, 0.0), (9.0, 9.2, 8.0, 9.5, 4.0)]
    frame = spark.createDataFrame([("a", "1h", T0 + timedelta(hours=i), *r) for i, r in enumerate(rows)], SCHEMA)
    found = cleaning.repaired_values(frame, ["symbol", "timeframe"]).orderBy("open_time").collect()
    assert [r.repair for r in found] == ["negative_price", "negative_volume", "no_volume", "envelope"]
    assert found[0].open == 9.0 and found[1].high == 9.5 and found[1].volume == 3.0 and found[2].low == 9.0 and found[2].volume == 2.0 and found[3].high == 9.5


def test_empty_frames_and_null_keys(spark):
    empty, odd = bars(spark, []), bars(spark, [1.0, None, 3.0], symbol=None)
    keys = ["symbol", "timeframe"]
    for frame in (empty, odd):
        for op in (
            lambda d: cleaning.filled(d, keys, "open_time", ["close"]), lambda d: cleaning.repaired_values(d, keys), lambda d: cleaning.emptied_outliers(d, keys, "open_time"), lambda d: cleaning.integrity_report(d, keys, "open_time"),
            lambda d: cleaning.market_checks(d, keys, "open_time"), lambda d: cleaning.missing_periods(d, keys, "open_time"), lambda d: cleaning.ohlc_normalized(d, keys), lambda d: resampling.resampled(d, keys, "open_time", 7_200),
            lambda d: cleaning.filled_by_class(d, keys, "open_time"), lambda d: cleaning.without_nulls(d, keys, "open_time", ["close"]), lambda d: trend.price_levels(d), lambda d: transforms.periodogram(d),
        ):
            op(frame).collect()
    assert cleaning.filled(odd, keys, "open_time", ["close"]).count() == 3
    assert resampling.resampled(odd, keys, "open_time", 7_200).count() == 2


def test_resampling_counts_from_the_first_bar(spark):
    rows = bars(spark, [float(i) for i in range(1, 8)]).withColumn("open_time", F.col("open_time") + F.expr("interval 30 minutes"))
    found = resampling.resampled(rows, ["symbol", "timeframe"], "open_time", 10_800).orderBy("open_time").collect()
    assert [r.open_time.minute for r in found] == [30, 30, 30] and [r.open for r in found] == [1.0, 4.0, 7.0] and [r.close for r in found] == [3.0, 6.0, 7.0]
    assert [r.volume for r in found] == [6.0, 6.0, 1.0]
    assert resampling.suggested_lengths(300) == [900, 3_600, 14_400, 86_400]
    with pytest.raises(ValueError, match="no longer length"):
        resampling.auto_resampled(rows, ["symbol", "timeframe"], "open_time", 604_800)


def test_kendall_and_inversions(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, 200)
    assert summaries.inversions(x) == sum(int(a > b) for i, a in enumerate(x) for b in x[i + 1 :])
    a, b = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    score = sum(np.sign(a[j] - a[i]) * np.sign(b[j] - b[i]) for i in range(60) for j in range(i + 1, 60))
    na, nb = (sum(v[i] != v[j] for i in range(60) for j in range(i + 1, 60)) for v in (a, b))
    found = summaries.kendall(bars(spark, a.tolist()).union(bars(spark, b.tolist(), symbol="b"))).first()
    assert abs(found.tau - score / np.sqrt(na * nb)) < 1e-12


def test_lag_of_a_repeating_series(spark):
    rng = np.random.default_rng(3)
    wave = 100 * np.exp(np.cumsum(np.tile(rng.normal(0, 0.01, 21), 12) + rng.normal(0, 0.0001, 252)))
    found = cycles.cycle_length(cycles.lag_correlations(bars(spark, wave.tolist()), 7, 60)).first()
    assert found.lag_days % 21 == 0 and found.corr > 0.99


def test_operations_and_transforms_by_name(spark):
    rows = bars(spark, [1.0, 2.0, 4.0, 8.0, 16.0])
    with pytest.raises(ValueError, match="unknown operations"):
        transforms.run_operations(rows, [("log", {}), ("magic", {})])
    with pytest.raises(ValueError, match="unknown method"):
        transforms.transformed(rows, "magic")
    found = transforms.run_operations(rows, [("log", {}), ("diff", {"lag": 1})]).orderBy("open_time").collect()
    assert found[0].value is None and all(abs(r.value - np.log(2)) < 1e-12 for r in found[1:])


def test_elimination_keeps_what_explains(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 4))
    y = 3 * x[:, 1] - 2 * x[:, 3] + rng.normal(0, 0.1, 300)
    rows = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    found = {r.feature: r.place for r in transforms.eliminated(rows, ["a", "b", "c", "d"], "y", 2).collect()}
    assert found["b"] == found["d"] == 1 and sorted([found["a"], found["c"]]) == [2, 3]
    mi = {r.feature: r.mi for r in transforms.mutual_information(rows, ["a", "b", "c", "d"], "y").collect()}
    assert min(mi["b"], mi["d"]) > max(mi["a"], mi["c"])


def test_impulse_fades_to_the_long_run(spark):
    fits = spark.createDataFrame([("a", 0.02, 0.1, 0.8, 0.9, float(np.log(0.5) / np.log(0.9)))], "symbol string, omega double, alpha double, beta double, persistence double, half_life double")
    found = {r.horizon: r for r in models.impulse_response(fits, (1, 2, 200)).collect()}
    assert abs(found[1].base - 0.2) < 1e-12 and abs(found[1].shocked - 0.22) < 1e-12 and abs(found[2].shocked - 0.218) < 1e-12 and abs(found[200].shocked - 0.2) < 1e-6


def test_registry_files_log_and_bootstrap(spark, tmp_path):
    stored = Registry(spark, str(tmp_path / "r"))
    (tmp_path / "model.bin").write_bytes(b"weights")
    stored.save_file("m1", str(tmp_path / "model.bin"), 1)
    assert bytes(stored.latest("model_files", model_key="m1").first().content) == b"weights"
    stored.log("loader", "INFO", "done", 1)
    assert stored.latest("event_log").first().message == "done"
    schemas = {"market_cycles": "symbol string, cycle_no long, end_at timestamp", "model_files": "model_key string"}
    assert stored.bootstrap(schemas) == ["market_cycles"] and stored.bootstrap(schemas) == []
    stored.save("market_cycles", spark.createDataFrame([("a", 1, T0), ("a", 2, None)], "symbol string, cycle_no long, end_at timestamp"), 1)
    assert [r.cycle_no for r in stored.active("market_cycles").collect()] == [2]


def test_sources_by_name(spark, tmp_path):
    spark.createDataFrame([(T0, 1)], "ts timestamp, v long").write.parquet(f"{tmp_path}/ticks.parquet")
    spark.createDataFrame([(1,)], "v long").write.parquet(f"{tmp_path}/flat.parquet")
    assert loading.load(spark, str(tmp_path), "ticks").columns == ["open_time", "v"]
    with pytest.raises(ValueError, match="no time column"):
        loading.load(spark, str(tmp_path), "flat")
    rows = bars(spark, [1.0, 2.0, 3.0]).withColumn("timeframe", F.lit("60m"))
    assert loading.scan_bars(rows, "1h", end="2024-01-01 01:00:00", limit=1, symbol="a").first().close == 2.0


def test_forecast_bounds_widen_with_the_model():
    ar = models.psi_weights(1, 0, np.array([0.0, 0.5]), 6)
    assert np.allclose(ar, 0.5 ** np.arange(6))
    ma = models.psi_weights(0, 1, np.array([0.0, 0.4]), 4)
    assert np.allclose(ma, [1, 0.4, 0, 0])
    walk = models.psi_weights(0, 0, np.array([0.0]), 5, 1)
    assert np.allclose(np.cumsum(walk**2), np.arange(1, 6))


def test_importance_and_tuning_along_time(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (200, 2))
    rows = spark.createDataFrame([("a", T0 + timedelta(hours=i), *map(float, r), float(2 * r[0] + rng.normal(0, 0.1))) for i, r in enumerate(x)], "symbol string, open_time timestamp_ntz, u double, v double, y double")
    found = {r.feature: r.importance for r in learning.permutation_importance(rows, ["u", "v"], "y").collect()}
    assert found["u"] > 1 and abs(found["v"]) < 0.05
    best = learning.tuned_regression(rows, ["u", "v"], "y").first()
    assert best.reg == 0.0 and best.rmse < 0.15
