"""Problems 2, 4 and 5 on small series, against brute force and on awkward input."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlery.functions.timeaxis import timeframe_label, timeframe_seconds
from candlery.operators import bars as bars_module
from candlery.operators import gridding, rolling, spikes

SCHEMA = "id long, venue string, feed_id string, timeframe string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, created_at timestamp_ntz, tb string, per string"
T0 = datetime(2024, 1, 1)


def bar(i, close=100.0, volume=1.0, feed="f", tf="1h", at=None, created=None, **kw):
    at = at or T0 + timedelta(hours=i)
    row = {"id": i, "venue": "v", "feed_id": feed, "timeframe": tf, "open_time": at, "open": close, "high": close, "low": close, "close": close, "volume": volume, "created_at": created or at + timedelta(hours=1), "tb": "clash", "per": "clash"}
    return tuple((row | kw).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_timeframe_spellings(spark):
    texts = ["1m", "1m ", "60s", "1min", "60m", "1H", " 4 hours", "240m", "1D", "24h", "1day", "1w", "1M", "x", "", None, "0m"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", timeframe_label(timeframe_seconds(F.col("t"))).alias("l")).collect()
    assert [r.l for r in rows] == ["1m", "1m", "1m", "1m", "1h", "1h", "4h", "4h", "1d", "1d", "1d", "1w", None, None, None, None, None]


def test_latest_delivery_counts_and_nearest_period(spark):
    late = T0 + timedelta(days=2)
    rows = [bar(1, 10.0), bar(2, 20.0, at=T0 + timedelta(hours=1, minutes=3), created=late), bar(3, 30.0, at=T0 + timedelta(hours=1, minutes=31))]
    found = {r.per: (r.id, r.close) for r in bars_module.latest_bars(frame(spark, rows), "close").collect()}
    hour = int((T0 - datetime(1970, 1, 1)).total_seconds() // 3600)
    assert found == {hour + 1: (2, 20.0), hour + 2: (3, 30.0)}


def test_rolling_totals_match_brute_force(spark):
    rng = np.random.default_rng(3)
    hours = sorted(rng.choice(24 * 60, 80, replace=False).tolist()) + [24 * 75]
    rows = [bar(h, float(rng.integers(50, 60)), float(rng.integers(0, 3))) for h in hours] + [bar(h, 1.0, None, feed=None) for h in (0, 30)]
    out = rolling.rolling_totals(frame(spark, rows), [7, 30]).where("feed_id = 'f'").orderBy("day_utc").collect()
    first = hours[0] // 24
    assert len(out) == hours[-1] // 24 - first + 1
    by_day = {}
    for r in rows[: len(hours)]:
        by_day.setdefault((r[4] - T0).days, []).append(r)
    for i, r in enumerate(out):
        day = first + i
        for n in (7, 30):
            inside = [x for d in range(day - n + 1, day + 1) for x in by_day.get(d, [])]
            assert r[f"volume_total_{n}"] == pytest.approx(sum(x[9] for x in inside))
            assert r[f"volume_avg_{n}"] == pytest.approx(sum(x[9] for x in inside) / n)
            assert r[f"bars_{n}"] == len(inside)
    idle = {r.day_utc for r in rolling.idle_days(frame(spark, rows)).where("feed_id = 'f'").collect()}
    assert idle == {r.day_utc for r in out if r.series_day >= 7 and r.active_7 == 0} and idle


def test_grid_has_every_period_once(spark):
    rows = [bar(0, 1.0), bar(1, None), bar(4, 4.0), bar(4, None, created=T0 + timedelta(days=9)), bar(6, 6.0)]
    out = gridding.regular_closes(frame(spark, rows)).orderBy("period_start").collect()
    assert [(r.close, r.close_filled, r.status) for r in out] == [
        (1.0, 1.0, "observed"), (None, 1.0, "filled"), (None, 1.0, "filled"), (None, 1.0, "filled"), (4.0, 4.0, "observed"), (None, 4.0, "filled"), (6.0, 6.0, "observed"),
    ]
    missing = [r.period_start for r in gridding.uncovered_periods(frame(spark, rows)).orderBy("period_start").collect()]
    assert missing == [f"2024-01-01 0{h}:00:00" for h in (1, 2, 3, 5)]


def test_step_function_weights(spark):
    rows = spark.createDataFrame([("a", 0.5, 10.0), ("a", 0.75, 20.0), ("a", 3.25, 8.0)], "k string, at double, value double")
    out = {r.cell: r for r in gridding.grid_cells(rows, ["k"], hold=1.0).collect()}
    assert out[0].twa == pytest.approx((0.25 * 10 + 0.25 * 20) / 0.5) and out[0].coverage == pytest.approx(0.5) and out[0].n == 2
    assert out[1].twa == 20.0 and out[1].coverage == pytest.approx(0.75)
    assert out[2].twa is None and out[2].coverage == 0
    assert out[3].twa == 8.0 and out[3].coverage == pytest.approx(0.75)


def test_blocks_are_invisible(spark, monkeypatch):
    """The same result whether a series fits into one block or is cut into many."""
    rng = np.random.default_rng(5)
    rows = [bar(int(h), float(100 + rng.normal())) for h in np.cumsum(rng.integers(1, 9, 300))]
    whole = sorted(map(tuple, gridding.regular_closes(frame(spark, rows)).collect()))
    flags = sorted(map(tuple, spikes.flagged_bars(frame(spark, rows)).drop("residual").collect()))
    for module in (bars_module, gridding):
        monkeypatch.setattr(module, "BLOCK_PERIODS", 16)
    monkeypatch.setattr(gridding, "GAP_CHUNK", 2)
    assert sorted(map(tuple, gridding.regular_closes(frame(spark, rows)).collect())) == whole
    assert sorted(map(tuple, spikes.flagged_bars(frame(spark, rows)).drop("residual").collect())) == flags


def test_implausible_bars(spark):
    rng = np.random.default_rng(11)
    close = 100 + np.cumsum(rng.normal(0, 0.1, 200))
    close[120:] += 20  # a move that stays is none
    volume = rng.uniform(1, 2, 200)
    spec = {i: {} for i in range(200)}
    spec[30] = {"high": float(close[30] + 50)}
    spec[50] = {"low": float(close[50] + 1)}
    spec[70] = {"volume": 90.0}
    close[90], close[91] = 300.0, 320.0
    close[150:156] = 133.0
    rows = [bar(i, **({"close": float(close[i]), "volume": float(volume[i])} | {k: v for k, v in spec[i].items() if k == "volume"}), **{k: v for k, v in spec[i].items() if k in ("high", "low")}) for i in range(200)]
    rows[10] = bar(10, None, 1.5)
    found = {r.id for r in spikes.implausible_ids(frame(spark, rows)).collect()}
    assert found >= {30, 50, 70, 90, 91, *range(150, 156)}
    assert not found & {118, 119, 120, 121, 122, 10, 89, 92}


ROSNER = """-0.25 0.68 0.94 1.15 1.20 1.26 1.26 1.34 1.38 1.43 1.49 1.49 1.55 1.56 1.58 1.65 1.69 1.70 1.76 1.77 1.81 1.91 1.94 1.96 1.99 2.06 2.09
 2.10 2.14 2.15 2.23 2.24 2.26 2.35 2.37 2.40 2.47 2.54 2.62 2.64 2.90 2.92 2.92 2.93 3.21 3.26 3.30 3.59 3.68 4.30 4.64 5.34 5.42 6.01"""


def esd_rows(spark, y, near, scale):
    """What the decomposition hands on, of residuals y: sums of those under ``near`` scales, the others one by one."""
    z = np.abs(y) / scale
    bulk = y[z < near]
    columns = "feed_id string, tf long, per long, y_price double, z_price double, n_price long, s_price double, q_price double, y_volume double, z_volume double, n_volume long, s_volume double, q_volume double"
    rows = [("f", 60, None, None, None, len(bulk), float(bulk.sum()), float((bulk**2).sum()), None, None, 0, None, None)]
    rows += [("f", 60, i, float(y[i]), float(z[i]), 0, None, None, None, None, 0, None, None) for i in np.flatnonzero(z >= near)]
    return spark.createDataFrame([tuple(int(v) if isinstance(v, np.integer) else v for v in r) for r in rows], columns)


def test_esd_on_a_published_example(spark):
    x = np.array(ROSNER.split(), float)
    y = x - np.median(x)
    bound = spikes.esd_bounds(esd_rows(spark, y, 1.5, 0.9), share=10 / 54).first().price_bound
    assert sorted(x[np.abs(y) / 0.9 >= bound - 1e-9]) == [5.34, 5.42, 6.01]
    limits = spikes.with_esd_limit(spark.createDataFrame([(54,), (53,), (52,), (45,)], "left long")).orderBy(F.desc("left")).collect()
    assert [round(r.esd_limit, 2) for r in limits] == [3.16, 3.15, 3.14, 3.09]


def test_esd_removes_one_by_one(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 400)
    y[:25] += rng.choice([-1, 1], 25) * rng.uniform(4, 60, 25)
    order = np.argsort(-np.abs(y))
    limits = {r.left: r.esd_limit for r in spikes.with_esd_limit(spark.range(300, 401).withColumnRenamed("id", "left")).collect()}
    last = 0
    for i in range(40):
        rest = y[order[i:]]
        if abs(rest[0] - rest.mean()) > limits[len(rest)] * rest.std(ddof=1):
            last = i + 1
    bound = spikes.esd_bounds(esd_rows(spark, y, 2.0, 1.0)).first().price_bound
    assert set(np.flatnonzero(np.abs(y) >= bound - 1e-9)) == set(order[:last]) and last > 15


def test_the_esd_stage_decides(spark):
    rng = np.random.default_rng(12)
    close, volume = 100 + np.cumsum(rng.normal(0, 0.1, 300)), rng.uniform(1, 2, 300)
    close[40] += 9.0
    volume[60:70] = 40.0  # a burst longer than any running median would notice
    rows = [bar(i, float(close[i]), float(volume[i])) for i in range(300)]
    flags = {r.id: r for r in spikes.flagged_bars(frame(spark, rows)).collect()}
    assert flags[40].outlier and flags[40].spike and all(flags[i].volume_outlier for i in range(60, 70))
    few = {r.id for r in spikes.flagged_bars(frame(spark, rows), share=0.0).where("volume_outlier").collect()}
    assert len(few) <= 1  # with no more than one value to remove, the others mask each other


def test_moves_across_closes_that_are_missing(spark, monkeypatch):
    monkeypatch.setattr(bars_module, "BLOCK_PERIODS", 8)
    rows = [bar(i, None if 3 <= i < 30 else 100.0 + i, 1.0 + i % 3) for i in range(40)]
    moves = {r.id: r.move for r in spikes._features(frame(spark, rows)).collect()}
    assert moves[30] == 28.0 and moves[31] == 1.0 and moves[10] is None


def test_empty_and_null_tables(spark):
    empty = frame(spark, [])
    odd = frame(spark, [(None,) * 13, bar(1, None, None), bar(1, None, None), bar(2, tf="?"), bar(3, feed=None)])
    for t in (empty, odd):
        for op in (rolling.rolling_totals, rolling.idle_days, gridding.regular_closes, gridding.uncovered_periods, spikes.implausible_ids):
            op(t).collect()
    assert rolling.rolling_totals(empty).count() == 0
    assert gridding.regular_closes(odd).count() == 2
