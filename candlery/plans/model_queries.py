"""Cycles of events, transforms, spectra, feature selection and sources, with DuckDB twins written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators import cycles, news, resampling, seasonality, summaries, transforms
from candlery.operators.features import CATALOG
from candlery.operators.registry import remaining_slices
from candlery.plans import relation_queries
from candlery.plans.candle_queries import DAILY_SQL, FOUR_HOURS_SQL, daily, four_hours
from candlery.plans.market_queries import K, KEYS, bars
from candlery.plans.summary_queries import FC, _forecasts, _rounded
from candlery.plans.twins import twin
from candlery.sources import loading
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
B, D = f"({FOUR_HOURS_SQL})", f"({DAILY_SQL})"
W = "partition by symbol order by open_time"
COLUMNS = ["close_lag_1", "close_lag_3", "volume_lag_1", "volume_lag_5"]


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resampled(bars(spark, folder).select("feed_id", "tf", "open_time", "close"), KEYS, "open_time", 86_400, origin="epoch")


DAYS = f"(select feed_id, tf, time_bucket(interval 1 day, open_time, timestamp '1970-01-01') as open_time, arg_max(close, open_time) filter (close is not null) as close from {K} group by 1, 2, 3)"


def y02_upgrade_cycles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _days(spark, folder)
    found = cycles.event_position(rows, cycles.calendar_of(rows, cycles.UPGRADES))
    found = found.withColumns({"stage": cycles.stage("open_time", cycles.STAGES), "transition": cycles.ramp("open_time", *cycles.RAMP)})
    return _rounded(found.withColumns({c: F.col(c).cast("long") for c in ("since", "until", "stage")}))


_EV = ", ".join(f"(date '{d}', '{n}', {w}::double)" for d, n, w in cycles.UPGRADES)
Y02_SQL = f"""with ev as (select * from (values {_EV}) t(day, name, weight)), d as (select * from {DAYS}), a as (select d.*, p.day as pd, p.name as event, p.weight from d asof left join ev p on cast(d.open_time as date) >= p.day),
 z as (select a.*, date_diff('day', pd, cast(open_time as date)) as since, date_diff('day', cast(open_time as date), (select min(day) from ev where day > cast(a.open_time as date))) as until from a)
 select feed_id, tf, open_time, round(close, 6) as close, since, until, round(since / (since + until), 6) as phase, round(ln(1 + since), 6) as log_since, round(sin(2 * pi() * since / (since + until)), 6) as phase_sin, round(cos(2 * pi() * since / (since + until)), 6) as phase_cos, event, weight,
 {" + ".join(f"cast(open_time >= timestamp '{d}' as bigint)" for d in cycles.STAGES)} as stage, round(greatest(0, least(1, date_diff('day', date '{cycles.RAMP[0]}', cast(open_time as date)) / date_diff('day', date '{cycles.RAMP[0]}', date '{cycles.RAMP[1]}'))), 6) as transition from z"""


def y03_outage_cycles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _days(spark, folder)
    found = cycles.event_position(rows, cycles.calendar_of(rows, [(d, "outage", w) for d, w in cycles.OUTAGES])).select(*rows.columns, F.col("since").cast("long").alias("since_outage"))
    maturity = F.least(F.lit(1.0), F.datediff(F.to_date("open_time"), F.to_date(F.lit(cycles.GROWTH[0]))) / 1095)
    return _rounded(found.withColumns({"stability": cycles.stability("open_time", cycles.OUTAGES), "growth_stage": cycles.stage("open_time", cycles.GROWTH).cast("long"), "maturity": maturity}))


_OUT = ", ".join(f"(date '{d}', {w})" for d, w in cycles.OUTAGES)
Y03_SQL = f"""with ev as (select * from (values {_OUT}) t(day, w)), d as (select * from {DAYS}), a as (select d.*, date_diff('day', p.day, cast(d.open_time as date)) as s, p.w from d asof left join ev p on cast(d.open_time as date) >= p.day)
 select feed_id, tf, open_time, round(close, 6) as close, s as since_outage, round(coalesce(1 - w * exp(-0.01 * s), 1), 6) as stability, {" + ".join(f"cast(open_time >= timestamp '{g}' as bigint)" for g in cycles.GROWTH)} as growth_stage, round(least(1, date_diff('day', date '{cycles.GROWTH[0]}', cast(open_time as date)) / 1095), 6) as maturity from a"""


def y06_lag_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(cycles.lag_correlations(daily(spark, folder)))


_LAGS = f"""r as (select symbol, row_number() over ({W}) as rn, close / nullif(lag(close) over ({W}), 0) - 1 as x from {D}), p as (select a.symbol, k.lag_days, b.x, a.x as y from r a, (select unnest(range(7, 366)) as lag_days) k, r b where b.symbol = a.symbol and b.rn = a.rn - k.lag_days and a.x is not null and b.x is not null),
 c as (select symbol, lag_days, count(*) as n, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) as corr from p group by 1, 2 having count(*) >= 10)"""


def y06_cycle_length(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(cycles.cycle_length(cycles.lag_correlations(daily(spark, folder))))


Y06_SQL = f"with {_LAGS}, q as (select *, lag(corr) over w < corr and lead(corr) over w < corr as peak from c window w as (partition by symbol order by lag_days)) select symbol, lag_days, round(corr, 6) as corr from q qualify row_number() over (partition by symbol order by coalesce(peak, false) desc, corr desc, lag_days) = 1"


def y12_events_of_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """The calendar of a chain, between the first and last delivered bar."""
    rows = table(spark, folder, "btc_klines")
    span = rows.agg(F.to_date(F.min("open_time")).alias("a"), F.to_date(F.max("open_time")).alias("b"))
    return cycles.calendar_of(rows, cycles.UPGRADES).join(F.broadcast(span), F.col("day").between(F.col("a"), F.col("b"))).select("day", "name", "weight")


Y12_SQL = f"select * from (values {_EV}) t(day, name, weight) where day between (select cast(min(open_time) as date) from btc_klines) and (select cast(max(open_time) as date) from btc_klines)"


def g02_fitted_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """Box-Cox with the fitted power, and back."""
    made = transforms.restored(transforms.transformed(daily(spark, folder), "boxcox"), "boxcox")
    return _rounded(made.select("symbol", "open_time", "power", "value", "restored"), 4)


G02_SQL = f"""with b as (select symbol, open_time, close from {D}), g as (select symbol, close, unnest([{", ".join(f"{x}::double" for x in transforms.LAMBDAS)}]) as power from b), v as (select symbol, power, close, case when power = 0 then ln(close) else (pow(close, power) - 1) / power end as y from g),
 l as (select symbol, power, -count(*) / 2 * ln(var_pop(y)) + (power - 1) * sum(ln(close)) as ll from v group by 1, 2), f as (select symbol, power from l qualify row_number() over (partition by symbol order by ll desc) = 1)
 select symbol, open_time, power, round(case when power = 0 then ln(close) else (pow(close, power) - 1) / power end, 4) as value, round(close, 4) as restored from b join f using (symbol)"""


def g03_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every transform undone: the greatest error of each."""
    out = None
    for m in ("log", "sqrt", "boxcox", "yeojohnson", "diff", "none"):
        rows = transforms.restored(transforms.transformed(daily(spark, folder), m), m)
        one = rows.groupBy("symbol").agg(F.round(F.max(F.abs(F.col("restored") - F.col("close"))), 2).alias("error"), F.count("restored").alias("n")).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


G03_SQL = f"select symbol, 0.0::double as error, count(*) as n, method from {D}, (select unnest(['log', 'sqrt', 'boxcox', 'yeojohnson', 'diff', 'none']) as method) group by 1, 4"
OPERATIONS = [("log", {}), ("clip_outliers", {"k": 1.5}), ("diff", {"lag": 6}), ("moving_average", {"window": 3}), ("zscore", {})]


def g04_operations(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(transforms.run_operations(four_hours(spark, folder), OPERATIONS))


G04_SQL = f"""with a as (select symbol, open_time, case when close > 0 then ln(close) end as v from {B}), q as (select symbol, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from a group by 1), c as (select a.symbol, open_time, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), v)) as v from a join q using (symbol)),
 d as (select symbol, open_time, v - lag(v, 6) over ({W}) as v from c), m as (select symbol, open_time, list(v) over ({W} rows between 1 preceding and 1 following) as l from d), e as (select symbol, open_time, case when len(list_filter(l, lambda x: x is not null)) = 3 then list_avg(l) end as v from m)
 select symbol, open_time, round((v - avg(v) over (partition by symbol)) / nullif(stddev_pop(v) over (partition by symbol), 0), 6) as value from e"""


def g09_periodogram(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(transforms.periodogram(four_hours(spark, folder)).withColumn("place", F.col("place").cast("long")), 3)


G09_SQL = f"""with r as (select symbol, row_number() over ({W}) - 1 as t, close - avg(close) over (partition by symbol) as x, count(*) over (partition by symbol) as n from {B}), f as (select symbol, n, k, sum(x * cos(2 * pi() * k * t / n)) as re, sum(x * sin(2 * pi() * k * t / n)) as im from (select *, unnest(range(1, n // 2 + 1)) as k from r where n >= 4) group by 1, 2, 3)
 select symbol, row_number() over (partition by symbol order by re * re + im * im desc, k) as place, round(n / k, 3) as period, round((re * re + im * im) / n, 3) as power from f qualify place <= 5"""


def _lagged(spark: SparkSession, folder: str) -> DataFrame:
    rows = four_hours(spark, folder)
    return CATALOG["w01_lagged"].apply(rows).join(CATALOG["w10_targets"].apply(rows).select("symbol", "open_time", "target_return"), ["symbol", "open_time"])


LAGGED = f"(select symbol, open_time, round(lag(close, 1) over w, 6) as close_lag_1, round(lag(close, 3) over w, 6) as close_lag_3, round(lag(volume, 1) over w, 6) as volume_lag_1, round(lag(volume, 5) over w, 6) as volume_lag_5, round(lead(close, 3) over w / nullif(close, 0) - 1, 6) as y from {B} window w as ({W}))"


def l01_mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(transforms.mutual_information(_lagged(spark, folder), COLUMNS, "target_return"), 5)


_CUT = [k / 8 for k in range(1, 8)]
L01_SQL = f"""with k as (select * from {LAGGED} where {" and ".join(f"{c} is not null" for c in (*COLUMNS, "y"))}), q as (select {", ".join(f"quantile_cont({c}, {_CUT}) as q_{c}" for c in (*COLUMNS, "y"))} from k),
 b as ({" union all ".join(f"select '{c}' as feature, len(list_filter(q_{c}, lambda z: z < {c})) as x, len(list_filter(q_y, lambda z: z < y)) as y from k, q" for c in COLUMNS)}),
 j as (select feature, x, y, count(*) as n from b group by all), t as (select *, sum(n) over (partition by feature, x) as nx, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as t from j) select feature, round(sum(n / t * ln(n * t / (nx * ny))), 5) as mi from t group by 1"""


def l01_eliminated(spark: SparkSession, folder: str) -> DataFrame:
    return transforms.eliminated(_lagged(spark, folder), COLUMNS, "target_return", 2)


def l03_polynomial_features(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(transforms.polynomial_features(four_hours(spark, folder), ["open", "close", "volume"]))


_Z = {c: f"greatest(-5, least(5, ({c} - avg({c}) over (partition by symbol)) / nullif(stddev_pop({c}) over (partition by symbol), 0)))" for c in ("close", "open", "volume")}
L03_SQL = f"with z as (select symbol, open_time, {', '.join(f'{x} as {c}' for c, x in _Z.items())} from {B}) select symbol, open_time, close * close as close_x_close, close * open as close_x_open, close * volume as close_x_volume, open * open as open_x_open, open * volume as open_x_volume, volume * volume as volume_x_volume from z"
L03_SQL = f"select symbol, open_time, {', '.join(f'round({c}, 6) as {c}' for c in ('close_x_close', 'close_x_open', 'close_x_volume', 'open_x_open', 'open_x_volume', 'volume_x_volume'))} from ({L03_SQL})"


def l09_banded_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Forecasts with bands by the fit of their model so far."""
    made = _forecasts(spark, folder)
    fit = summaries.forecast_accuracy(made, four_hours(spark, folder)).select("symbol", "model", F.col("r2").alias("confidence"))
    return _rounded(transforms.banded_predictions(made.join(fit, ["symbol", "model"])), 8)


L09_SQL = f"""with {FC}, c as (select symbol, model, 1 - sum(pow(actual - forecast, 2)) / nullif(var_pop(actual) * count(*), 0) as confidence from f group by 1, 2), w as (select symbol, open_time, model, forecast, confidence, abs(forecast) * 0.1 * (1 - greatest(0, least(1, coalesce(confidence, 0)))) as half from f join c using (symbol, model))
 select symbol, open_time, model, round(forecast, 8) as forecast, round(confidence, 8) as confidence, round(forecast - half, 8) as lower, round(forecast + half, 8) as upper from w"""


def s01_scanned(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred newest hourly bars of a span."""
    rows = loading.scan_bars(table(spark, folder, "btc_klines"), "1h", "2023-01-01 00:00:00", "2024-06-30 00:00:00", 100)
    return rows.select("id", "feed_id", "timeframe", "open_time", "close")


S01_SQL = "select id, feed_id, timeframe, open_time, close from btc_klines where lower(trim(timeframe)) in ('1h', '60m', '1hour', '60min') and open_time between timestamp '2023-01-01 00:00:00' and timestamp '2024-06-30 00:00:00' order by open_time desc, id, venue, feed_id limit 100"


def s02_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Three sources with one time column."""
    out = None
    for source in ("events", "orders", "btc_klines"):
        one = loading.load(spark, folder, source, []).agg(F.count("open_time").alias("n"), F.min("open_time").cast("timestamp_ntz").alias("first_at"), F.max("open_time").cast("timestamp_ntz").alias("last_at")).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    return out


S02_SQL = " union all ".join(f"select count({t}) as n, min({t}) as first_at, max({t}) as last_at, '{s}' as source from {s}" for s, t in (("events", "ts"), ("orders", "o_orderdate"), ("btc_klines", "open_time")))


def s08_filled_from_others(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of every feed, missing hours taken from the mean of all feeds."""
    mine = bars(spark, folder).where("tf = 3600 and close is not null").select("feed_id", "open_time", "close")
    span = mine.groupBy("feed_id").agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    others = mine.groupBy("open_time").agg(F.avg("close").alias("close")).join(span, F.col("open_time").between(F.col("a"), F.col("b"))).select("feed_id", "open_time", "close")
    return _rounded(loading.filled_from(mine, others, ["feed_id", "open_time"]))


S08_SQL = f"""with m as (select feed_id, open_time, close from {K} where tf = 3600 and close is not null), o as (select open_time, avg(close) as close from m group by 1), s as (select feed_id, min(open_time) as a, max(open_time) as b from m group by 1)
 select feed_id, open_time, round(close, 6) as close, 0 as filled from m union all select s.feed_id, o.open_time, round(o.close, 6), 1 from o join s on o.open_time between a and b where not exists (select 1 from m where m.feed_id = s.feed_id and m.open_time = o.open_time)"""


def s15_parametrised(spark: SparkSession, folder: str) -> DataFrame:
    text = "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from {orders} where o_totalprice >= :least and o_orderstatus = :status group by o_orderpriority"
    return loading.run_sql(spark, text, {"least": 100_000.0, "status": "O"}, orders=table(spark, folder, "orders"))


S15_SQL = "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice >= 100000 and o_orderstatus = 'O' group by 1"


def n12_stored_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The latest item of each link with the numbers of its source and category."""
    from candlery.operators.joins import latest_versions

    items = table(spark, folder, "news_items").where("link is not null").select("link", "news_id", "source", "category", "score").distinct()
    latest = latest_versions(items, ["link"], ["news_id"])
    for column, key in (("source", "source_no"), ("category", "category_no")):
        latest = latest.join(loading.dimension(items, column, key), column, "left")
    return latest.select("link", "news_id", "source_no", "category_no", "score")


N12_SQL = """with i as (select distinct link, news_id, source, category, score from news_items where link is not null), l as (select * from i qualify row_number() over (partition by link order by news_id desc nulls last, source desc nulls last, category desc nulls last, score desc nulls last) = 1),
 s as (select source, row_number() over (order by source) as source_no from (select distinct source from i where source is not null)), c as (select category, row_number() over (order by category) as category_no from (select distinct category from i where category is not null))
 select link, news_id, source_no, category_no, score from l left join s using (source) left join c using (category)"""


def n10_news_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One short record of each item: title cut to eighty characters, mood, its label, topics counted."""
    mood = F.coalesce("sentiment_score", F.lit(0.0))
    label = F.when(mood > 0.2, "positive").when(mood < -0.2, "negative").otherwise("neutral")
    rows = table(spark, folder, "news_items").distinct()
    return rows.select("news_id", F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title"), "source", F.round(mood, 2).alias("mood"), label.alias("label"), F.coalesce(F.array_size("topics"), F.lit(0)).cast("long").alias("n_topics"))


N10_SQL = "select distinct news_id, left(coalesce(title, ''), 80) as title, source, round(coalesce(sentiment_score, 0), 2) as mood, case when coalesce(sentiment_score, 0) > 0.2 then 'positive' when coalesce(sentiment_score, 0) < -0.2 then 'negative' else 'neutral' end as label, coalesce(len(topics), 0) as n_topics from (select distinct * from news_items)"


def o07_flagged_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars that any outlier rule flags."""
    return CATALOG["o02_robust_outliers"].apply(four_hours(spark, folder)).where("is_anomaly = 1").select("symbol", "open_time", "z_close", "z_volume")


O07_SQL = f"select symbol, open_time, z_close, z_volume from ({twin('o02_robust_outliers', FOUR_HOURS_SQL)}) where is_anomaly = 1"



def j10_cross_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(transforms.cross_ratios(four_hours(spark, folder), ["high", "close"], ["low", "volume", "close"]))


_PAIRS = [(a, b) for a in ("high", "close") for b in ("low", "volume", "close") if a != b]
J10_SQL = f"""with r as (select symbol, open_time, {", ".join(f"{a} / nullif({b}, 0) as {a}_per_{b}" for a, b in _PAIRS)} from {B}), c as (select symbol, {", ".join(f"quantile_cont({a}_per_{b}, 0.01) as lo_{a}_{b}, median({a}_per_{b}) as mid_{a}_{b}, quantile_cont({a}_per_{b}, 0.99) as hi_{a}_{b}" for a, b in _PAIRS)} from r group by 1)
 select symbol, open_time, {", ".join(f"round(case when coalesce({a}_per_{b}, mid_{a}_{b}) < lo_{a}_{b} then lo_{a}_{b} when coalesce({a}_per_{b}, mid_{a}_{b}) > hi_{a}_{b} then hi_{a}_{b} else coalesce({a}_per_{b}, mid_{a}_{b}) end, 6) as {a}_per_{b}" for a, b in _PAIRS)} from r join c using (symbol)"""


def a02_quarter_seasons(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(seasonality.period_seasonality(daily(spark, folder), "quarter", 3))


A02_SQL = f"""with d as (select *, max(year(open_time)) over (partition by symbol) as last_year from {D}), p as (select symbol, year(open_time) as y, quarter(open_time) as period, arg_max(close, open_time) / nullif(arg_min(close, open_time), 0) - 1 as r from d where year(open_time) > last_year - 3 group by 1, 2, 3),
 g as (select symbol, period, count(*) as n, avg(r) as mean, stddev_samp(r) as sd, avg(cast(r > 0 as double)) as rising, arg_max(y, r) as best_year, arg_min(y, r) as worst_year from p group by 1, 2), z as (select *, (mean - avg(mean) over (partition by symbol)) / nullif(stddev_pop(mean) over (partition by symbol), 0) as z from g)
 select symbol, period, n, round(mean, 6) as mean, round(sd, 6) as sd, round(rising, 6) as rising, best_year, worst_year, round(z, 6) as z, cast(coalesce(abs(z) > 1.96, false) as bigint) as significant from z"""


def y07_event_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Returns since the latest upgrade, bar by bar, of every series of daily bars."""
    rows = _days(spark, folder)
    placed = cycles.event_position(rows, cycles.calendar_of(rows, cycles.UPGRADES)).select("feed_id", "tf", "open_time", "close", F.coalesce("event", F.lit("none")).alias("event"))
    return _rounded(seasonality.segment_returns(placed, ["feed_id", "tf"], "event"), 5)


Y07_SQL = f"""with ev as (select * from (values {_EV}) t(day, name, weight)), d as (select * from {DAYS} where close is not null), a as (select d.feed_id, d.tf, d.open_time, d.close, coalesce(p.name, 'none') as event from d asof left join ev p on cast(d.open_time as date) >= p.day),
 r as (select *, row_number() over w as bar_no, close / nullif(first(close) over w, 0) - 1 as roi from a window w as (partition by feed_id, tf, event order by open_time))
 select feed_id, tf, open_time, round(close, 5) as close, event, bar_no, round(roi, 5) as roi, round((roi - avg(roi) over (partition by feed_id, tf, event)) / nullif(stddev_pop(roi) over (partition by feed_id, tf, event), 0), 5) as roi_z from r"""


def s06_remaining_slices(spark: SparkSession, folder: str) -> DataFrame:
    """What each feed lacks up to a day, in windows of a hundred days."""
    rows = table(spark, folder, "btc_klines").withColumn("close_time", F.col("close_time").cast("timestamp_ntz"))
    return remaining_slices(rows, ["feed_id"], "close_time", "2025-06-30 00:00:00", "100 days")


S06_SQL = """with l as (select feed_id, max(close_time) + interval 1 millisecond as a from btc_klines group by 1), s as (select feed_id, unnest(generate_series(a, timestamp '2025-06-30 00:00:00' - interval 1 microsecond, interval 100 day)) as slice_start from l where a < timestamp '2025-06-30 00:00:00')
 select feed_id, slice_start, least(slice_start + interval 100 day, timestamp '2025-06-30 00:00:00') as slice_end from s"""

def n11_enriched(spark: SparkSession, folder: str) -> DataFrame:
    return news.enriched(table(spark, folder, "documents"))


_N = relation_queries.oracle_sql()
N11_SQL = f"""select s.doc_id, s.score, s.label, i.importance, t.topic, c.coin from ({_N["n01_sentiment"]}) s join ({_N["n04_importance"]}) i on s.doc_id = i.doc_id left join (select doc_id, topic from ({_N["n05_topics"]}) where place = 1) t on t.doc_id = s.doc_id
 left join (select doc_id, coin from ({_N["n03_named_mentions"]}) where is_top = 1) c on c.doc_id = s.doc_id"""


def w07_cycle_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with calendar waves, market phase and bull or bear state as 0/1 columns."""
    rows = daily(spark, folder)
    found = CATALOG["y04_market_phase"].apply(rows).join(CATALOG["y05_bull_bear"].apply(rows).select("symbol", "open_time", "is_bull"), ["symbol", "open_time"])
    found = cycles.one_hot(found, "phase", [1, 2, 3, 4], ["accumulation", "uptrend", "distribution", "downtrend"])
    found = cycles.one_hot(found, "is_bull", [1, 0], ["bull", "bear"])
    return _rounded(cycles.calendar_waves(found).drop("phase", "is_bull"))


_WAVES = {"weekday": ("isodow(open_time) - 1", 7), "month": ("month(open_time) - 1", 12), "week": ("weekofyear(open_time)", 52)}
W07_SQL = f"""select p.symbol, p.open_time, {", ".join(f"cast(phase = {k} as bigint) as {n}" for k, n in ((1, "accumulation"), (2, "uptrend"), (3, "distribution"), (4, "downtrend")))}, cast(coalesce(is_bull = 1, false) as bigint) as bull, cast(coalesce(is_bull = 0, false) as bigint) as bear,
 isodow(p.open_time) - 1 as weekday_no, month(p.open_time) as month_no, quarter(p.open_time) as quarter_no, day(p.open_time) as day_no, {", ".join(f"round({f}(2 * pi() * ({x.replace('open_time', 'p.open_time')}) / {k}), 6) as {n}_{f}" for n, (x, k) in _WAVES.items() for f in ("sin", "cos"))}
 from ({twin("y04_market_phase", DAILY_SQL)}) p join ({twin("y05_bull_bear", DAILY_SQL)}) b on p.symbol = b.symbol and p.open_time = b.open_time"""

TWINS = {
    "y02_upgrade_cycles": Y02_SQL, "y03_outage_cycles": Y03_SQL, "y06_lag_correlations": f"with {_LAGS} select symbol, lag_days, n, round(corr, 6) as corr from c", "y06_cycle_length": Y06_SQL, "y12_events_of_symbol": Y12_SQL, "g02_fitted_transforms": G02_SQL,
    "g03_restored": G03_SQL, "g04_operations": G04_SQL, "g09_periodogram": G09_SQL, "l01_mutual_information": L01_SQL, "l01_eliminated": "", "l03_polynomial_features": L03_SQL, "l09_banded_predictions": L09_SQL, "s01_scanned": S01_SQL, "s02_loaded": S02_SQL,
    "s08_filled_from_others": S08_SQL, "s15_parametrised": S15_SQL, "n12_stored_articles": N12_SQL, "n10_news_summary": N10_SQL, "o07_flagged_bars": O07_SQL, "j10_cross_ratios": J10_SQL, "n11_enriched": N11_SQL, "w07_cycle_calendar": W07_SQL, "a02_quarter_seasons": A02_SQL, "y07_event_segments": Y07_SQL, "s06_remaining_slices": S06_SQL,
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in TWINS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in TWINS.items() if sql}
