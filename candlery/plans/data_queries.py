"""Queries of the general data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators import gridding, instants, loglines, rolling, spikes
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.idle_days(table(spark, folder, "btc_klines"))


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    rolled = rolling.rolling_totals(table(spark, folder, "btc_klines"))
    shown = [(c, kind) for c, kind in rolled.dtypes if not c.startswith("close_mean")]
    return rolled.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in shown])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return instants.news_instants(table(spark, folder, "news_items"), table(spark, folder, "news_sources"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.uncovered_periods(table(spark, folder, "btc_klines"))


def p4_grid(spark: SparkSession, folder: str) -> DataFrame:
    return gridding.regular_closes(table(spark, folder, "btc_klines"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.implausible_ids(table(spark, folder, "btc_klines"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return loglines.log_entries(table(spark, folder, "logs"), with_message=False)


def p6_entries(spark: SparkSession, folder: str) -> DataFrame:
    return loglines.log_entries(table(spark, folder, "logs"))


def queries() -> dict[str, Query]:
    found = [p2_found, p2_rolling, p3_found, p4_found, p4_grid, p5_found, p6_found, p6_entries]
    return {f.__name__: f for f in found}


# --- DuckDB twins: a bar's series and period, the counting bar of each, and calendars from generated series

BARS_SQL = """t as (select *, regexp_extract(trim(timeframe), '^([0-9]+) *[A-Za-z]+$', 1) as k, regexp_extract(trim(timeframe), '^[0-9]+ *([A-Za-z]+)$', 1) as u from btc_klines where open_time is not null),
 s as (select *, cast(k as bigint) * case when lower(u) in ('s', 'sec') then 1 when lower(u) in ('m', 'min') and u <> 'M' then 60 when lower(u) in ('h', 'hour') then 3600 when lower(u) in ('d', 'day') then 86400 end as tf from t where k <> ''),
 placed as (select *, cast((epoch_us(open_time) + tf * 500000) // (tf * 1000000) as bigint) as per from s where tf is not null),
 counting as (select * from placed qualify row_number() over (partition by feed_id, tf, per order by created_at desc, id desc) = 1)"""
LABEL_SQL = "case when tf % 86400 = 0 then (tf // 86400) || 'd' when tf % 3600 = 0 then (tf // 3600) || 'h' when tf % 60 = 0 then (tf // 60) || 'm' else tf || 's' end"
DAYS_SQL = f"""{BARS_SQL}, sparse as (select feed_id, tf, cast(per * tf // 86400 as bigint) as day, count(*) as bars, count(*) filter (volume > 0) as active, coalesce(sum(volume), 0) as volume, coalesce(sum(close), 0) as close from counting group by 1, 2, 3),
 span as (select feed_id, tf, min(day) as lo, max(day) as hi from sparse group by 1, 2), cal as (select feed_id, tf, lo, unnest(range(lo, hi + 1)) as day from span),
 days as (select c.feed_id, c.tf, c.day, c.day - c.lo + 1 as series_day, coalesce(bars, 0) as bars, coalesce(active, 0) as active, coalesce(volume, 0) as volume, coalesce(close, 0) as close
   from cal c left join sparse p on c.feed_id is not distinct from p.feed_id and c.tf = p.tf and c.day = p.day)"""


def _trailing(n: int) -> str:
    over = f"over (partition by feed_id, tf order by day rows {n - 1} preceding)"
    return (
        f"cast(sum(bars) {over} as bigint) as bars_{n}, cast(sum(active) {over} as bigint) as active_{n}, round(sum(volume) {over}, 6) as volume_total_{n}, round(sum(volume) {over} / {n}, 6) as volume_avg_{n}, "
        f"round(sum(close) {over}, 6) as close_total_{n}, round(sum(close) {over} / {n}, 6) as close_avg_{n}"
    )


DAY_SQL = "strftime(date '1970-01-01' + cast(day as integer), '%Y-%m-%d')"
P2_SQL = f"with {DAYS_SQL} select feed_id, {LABEL_SQL} as timeframe, {DAY_SQL} as day_utc, series_day, {_trailing(7)}, {_trailing(30)} from days"
P2_FOUND_SQL = f"with {DAYS_SQL}, w as (select *, sum(active) over (partition by feed_id, tf order by day rows 6 preceding) as a7 from days) select feed_id, {LABEL_SQL} as timeframe, {DAY_SQL} as day_utc from w where series_day >= 7 and a7 = 0"
CELLS_SQL = f"""{BARS_SQL}, best as (select feed_id, tf, per, max_by(close, {{'a': created_at, 'b': id}}) as close from placed where close is not null group by 1, 2, 3), span as (select feed_id, tf, min(per) as lo, max(per) as hi from placed group by 1, 2),
 cells as (select feed_id, tf, unnest(range(lo, hi + 1)) as per from span), grid as (select c.feed_id, c.tf, c.per, b.close from cells c left join best b on c.feed_id is not distinct from b.feed_id and c.tf = b.tf and c.per = b.per)"""
START_SQL = "strftime(make_timestamp(per * tf * 1000000), '%Y-%m-%d %H:%M:%S')"
P4_FOUND_SQL = f"with {CELLS_SQL} select feed_id, {LABEL_SQL} as timeframe, {START_SQL} as period_start from grid where close is null"
P4_SQL = f"""with {CELLS_SQL}, f as (select *, last_value(close ignore nulls) over (partition by feed_id, tf order by per rows unbounded preceding) as filled from grid)
 select feed_id, {LABEL_SQL} as timeframe, {START_SQL} as period_start, close, filled as close_filled, case when close is null then 0.0 else 1.0 end::double as coverage,
 case when close is not null then 'observed' when filled is not null then 'filled' else 'missing' end as status from f"""


# the exact rule of implausible bars by lists of neighbouring bars; it knows no decomposition and no outlier test
_PW = "partition by feed_id, tf order by per"
_PRICE = "case when close > 0 then close end"
_CALM = ", ".join(f"{f}(case when abs(off) < 9 * tm then price end, {k}) over ({_PW}) as {n}{k}" for f, n in (("lag", "b"), ("lead", "a")) for k in (1, 2, 3))
P5_FOUND_SQL = f"""with {BARS_SQL}, b as (select feed_id, tf, per, id, open, high, low, close, volume, {_PRICE} as price, list_sort(list_filter(list({_PRICE}) over ({_PW} rows between 3 preceding and 3 following), lambda v: v is not null)) as near,
  last_value({_PRICE} ignore nulls) over ({_PW} rows between unbounded preceding and 1 preceding) as before, list({{'c': close, 'v': volume}}) over ({_PW} rows 5 preceding) as six from counting),
 m as (select *, price - near[len(near) // 2 + 1] as off, abs(price - before) as move,
  len(list_filter(six, lambda e: e.v > 0)) = 6 and (len(list_filter(six, lambda e: e.c = close)) = 6 or len(list_filter(six, lambda e: e.v = volume)) = 6) as run from b),
 usual as (select feed_id, tf, quantile_disc(move, 0.5) as tm, quantile_disc(volume, 0.5) filter (volume > 0) as tv from m group by 1, 2),
 n0 as (select m.*, tm, tv from m join usual s on m.feed_id is not distinct from s.feed_id and m.tf = s.tf), n as (select *, max(run) over ({_PW} rows between current row and 5 following) as stuck from n0), k as (select *, {_CALM} from n),
 r as (select *, coalesce(b1, b2, b3) as before_, coalesce(a1, a2, a3) as after_ from k)
 select id from r where least(open, high, low, close) <= 0 or volume < 0 or high < low or open > high or open < low or close > high or close < low or stuck
  or (tm > 0 and (greatest(high, low, close) - greatest(before_, after_) >= 18 * tm or least(before_, after_) - least(high, low, close) >= 18 * tm) and before_ is not null and after_ is not null) or volume >= 10 * tv"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND_SQL, "p2_rolling": P2_SQL, "p4_found": P4_FOUND_SQL, "p4_grid": P4_SQL, "p5_found": P5_FOUND_SQL}
