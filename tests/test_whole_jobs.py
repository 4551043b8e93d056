"""Queries that must leave nothing of their input out, against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlery.operators import correlation, learning, models, pipeline, seasonality
from candlery.operators.features import CATALOG
from candlery.plans import relation_queries, report_queries

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


def bars_of(spark, closes, symbol="a"):
    rows = spark.createDataFrame([(symbol, i, float(x)) for i, x in enumerate(closes)], "symbol string, i long, close double")
    return rows.select("symbol", F.timestamp_seconds(F.col("i") * 86_400).cast("timestamp_ntz").alias("open_time"), "close")


def test_every_past_stretch_is_measured(spark):
    x = np.random.default_rng(3).normal(50, 5, 75)
    x[13:33] = x[55:]  # the best match begins at no multiple of 20
    found = {r.bars_back: r.distance for r in seasonality.similar_stretches(bars_of(spark, x)).collect()}
    z = (x - x.mean()) / x.std()
    assert found == {k: pytest.approx(float(np.sqrt(((z[55:] - z[55 - k : 75 - k]) ** 2).sum())), abs=2e-6) for k in range(20, 56)}
    assert min(found, key=found.get) == 42 and found[42] == 0


@needs_data
def test_y08_has_all_offsets(spark):
    query, text = report_queries.queries()["y08_similar_stretches"], report_queries._reports()["y08_similar_stretches"]
    mine = {(r.symbol, r.bars_back): r.distance for r in query(spark, FOLDER).collect()}
    some = {(r.symbol, r.bars_back): r.distance for r in text.run(spark, FOLDER).collect()}
    assert some and all(mine[k] == pytest.approx(d, abs=2e-6) for k, d in some.items())
    days = {r.symbol: r["count"] for r in report_queries.daily(spark, FOLDER).groupBy("symbol").count().collect()}
    assert set(mine) == {(s, k) for s, n in days.items() for k in range(20, n - 19)}


@needs_data
def test_w16_has_all_bars_and_groups(spark):
    out = relation_queries.w16_feature_frame(spark, FOLDER).drop("target_return")
    plans = [CATALOG[g] for g in pipeline.GROUPS]
    assert {c for p in plans for stage in p.stages for c in stage if c not in p.hidden} <= set(out.columns)
    bars = relation_queries.four_hours(spark, FOLDER)
    with_target = CATALOG["w10_targets"].apply(bars).where("target_return is not null")
    keys = lambda d: sorted((r.symbol, r.open_time) for r in d.select("symbol", "open_time").collect())
    assert keys(out) == keys(with_target) and len(keys(out)) > 0


def test_autocorrelation_to_lag_30(spark):
    x = np.exp(np.random.default_rng(5).normal(0, 0.1, 90).cumsum())
    found = {r.lag_bars: r.acf for r in correlation.autocorrelation(bars_of(spark, x)).collect()}
    d = np.diff(np.log(x)) ** 2
    d = d - d.mean()
    assert found == {k: pytest.approx(float((d[k:] * d[:-k]).sum() / (d * d).sum()), abs=2e-6) for k in range(1, 31)}


@needs_data
def test_j02_has_all_symbols(spark):
    out = relation_queries.j02_wide_panel(spark, FOLDER)
    bars = relation_queries.four_hours(spark, FOLDER).collect()
    assert set(out.columns) == {"open_time"} | {f"close_{b.symbol}" for b in bars}
    found = {(c, r.open_time): r[c] for r in out.collect() for c in out.columns[1:] if r[c] is not None}
    assert found == {(f"close_{b.symbol}", b.open_time): pytest.approx(b.close, abs=1e-4) for b in bars}


def test_news_clusters_do_not_depend_on_parts(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["біржа", "ринок", "токен", "звіт", "фонд", "банк", "курс", "рада", "вузол", "міст"]
    sets = [frozenset(rng.choice(vocabulary, rng.integers(0, 6), replace=False).tolist()) for _ in range(60)]
    rows = [(i, " ".join(s), f"2024-01-01 10:{i:02d}:00", "uk") for i, s in enumerate(sets)]
    items = spark.createDataFrame(rows, "doc_id long, text string, published_at string, lang string").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))
    heads, expected = [], {}
    for i, s in enumerate(sets):
        k = next((k for k, h in enumerate(heads) if s and len(s & h) >= 0.5 * len(s | h)), len(heads))
        heads += [s] if k == len(heads) else []
        expected[i] = k
    for most in (7, 2_000):
        out = learning.news_clusters(items, most=most).collect()
        assert {r.doc_id: r.cluster for r in out} == expected
    assert all(r.representative == min(i for i, k in expected.items() if k == r.cluster) for r in out)


def components_of(values, k=2):
    """Components by numpy, of missing values as medians and columns without any as constants."""
    x = np.array(values, float)
    for c in range(x.shape[1]):
        gone = np.isnan(x[:, c])
        x[gone, c] = 0.0 if gone.all() else np.median(x[~gone, c])
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
    size, loadings = np.linalg.eigh(np.cov(z.T))
    loadings = loadings[:, np.argsort(-size)][:, :k]
    return z @ (loadings * np.where(loadings[0] >= 0, 1.0, -1.0))


def components_found(spark, values):
    rows = [("a", i, *[None if v is None else float(v) for v in r]) for i, r in enumerate(values)]
    frame = spark.createDataFrame(rows, "symbol string, i long, x double, y double, z double").withColumn("open_time", F.timestamp_seconds("i").cast("timestamp_ntz"))
    out = models.principal_components(frame, ["x", "y", "z"])
    assert out.columns == ["symbol", "open_time", "pc_1", "pc_2"] and {t for _, t in out.dtypes[2:]} == {"double"}
    return [(r.pc_1, r.pc_2) for r in out.orderBy("open_time").collect()]


def test_components_of_rows_that_lack_values(spark):
    rng = np.random.default_rng(9)
    full = rng.normal(0, 1, (40, 3)) @ np.array([[2, 1, 0.3], [0, 1, 0.5], [0, 0, 0.4]])
    some, empty, nan = [[list(r) for r in full] for _ in range(3)]
    for i in range(40):
        empty[i][1] = None
        some[i][i % 3] = None if i % 2 else some[i][i % 3]
        nan[i][2] = float("nan") if i % 5 == 0 else nan[i][2]
    for values in (full, some, empty, nan):
        assert np.allclose(components_found(spark, values), components_of([[np.nan if v is None else v for v in r] for r in values]), atol=1e-9)
    assert components_found(spark, [[1, None, 3]]) == [(0.0, None)] and components_found(spark, []) == []


def estimators_of(bars, n=14):
    """The three volatilities of one symbol's bars in order of time, by loops; bars without a range are left out of means."""
    x = np.array([(b.open, b.high, b.low, b.close) for b in bars], float)
    x[x <= 0] = np.nan
    o, h, low, c = x.T
    hl, co = np.log(h / low) ** 2, np.log(c / o) ** 2
    moves, out = np.concatenate([[np.nan], np.diff(np.log(c))]), []
    for i in range(len(x)):
        at = slice(i - n + 1, i + 1)
        gk = 0.5 * hl - (2 * np.log(2) - 1) * co
        mean = lambda v: v[at][~np.isnan(v[at])].mean() if i >= n - 1 and not np.isnan(v[at]).all() else np.nan  # noqa: B023, E731
        out.append((moves[at].std(ddof=1) * np.sqrt(365) if i >= n - 1 else np.nan, np.sqrt(mean(hl) / (4 * np.log(2)) * 365), np.sqrt(np.maximum(mean(gk), 0) * 365)))
    return out


def l02_checked(spark, folder):
    bars = relation_queries.four_hours(spark, folder).orderBy("symbol", "open_time").collect()
    values = [v for s in sorted({b.symbol for b in bars}) for v in estimators_of([b for b in bars if b.symbol == s])]
    out = relation_queries.queries()["l02_principal_components"](spark, folder).orderBy("symbol", "open_time").collect()
    assert [(r.symbol, r.open_time) for r in out] == [(b.symbol, b.open_time) for b in bars]
    assert np.allclose([(r.pc_1, r.pc_2) for r in out], components_of(values), atol=1e-4)
    return np.array(values)


def test_l02_has_all_bars_when_every_window_holds_a_zero(spark, tmp_path):
    """As with many ticks a bar: no window of 14 bars is without a price of 0, so none has the range of all its bars."""
    rng = np.random.default_rng(4)
    rows = [(4 * i + t, s, 14_400 * i + 60 * t, 0.0 if t == 1 and i % 10 == 0 else float(rng.integers(100, 900))) for s in ("a", "b") for i in range(50) for t in range(4)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, s long, value double")
    events.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert np.isnan(l02_checked(spark, str(tmp_path))).any(axis=0).all()


@needs_data
def test_l02_has_all_bars(spark):
    l02_checked(spark, FOLDER)
