"""Cleaning, filling, scaling and resampling of the delivered bars of btc_klines, with DuckDB twins written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators import cleaning, resampling
from candlery.operators.bars import feed, latest_bars
from candlery.plans.data_queries import BARS_SQL
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("feed_id", "tf")
PRICES = cleaning.PRICES
DAY = 86_400


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """feed_id, tf, open_time, id and prices of every series of btc_klines, its latest delivery of each period."""
    rows = latest_bars(table(spark, folder, "btc_klines"), *cleaning.BARS)
    at = F.timestamp_add("SECOND", F.col("per") * F.col("tf"), F.expr(resampling.EPOCH))
    return rows.select("feed_id", "tf", at.alias("open_time"), "id", *cleaning.BARS)


def _out(df: DataFrame, *rounded: str, digits: int = 6) -> DataFrame:
    found = df.withColumns({c: F.round(c, digits) for c in rounded})
    return found.select(*[feed() if c == "feed_id" else F.col(c) for c in found.columns])


K = f"(with {BARS_SQL} select feed_id, tf, make_timestamp(cast(per * tf * 1000000 as bigint)) as open_time, id, open, high, low, close, volume from counting)"
W = "(partition by feed_id, tf order by open_time)"
BACK, AHEAD = (f"(partition by feed_id, tf order by open_time rows between {x})" for x in ("unbounded preceding and current row", "current row and unbounded following"))
STATS = f"(select feed_id, tf, {', '.join(f'quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}, quantile_cont({c}, 0.5) filter ({c} > 0) as m_{c}, avg({c}) as mean_{c}, median({c}) as median_{c}' for c in cleaning.BARS)}, min(volume) filter (volume > 0) as least_v, stddev_samp(volume) as sd_v from {K} group by 1, 2)"
ON = "on k.feed_id is not distinct from s.feed_id and k.tf = s.tf"


def f02_prepared(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "btc_klines").select("id", F.col("open_time").cast("string").alias("seen_at"), F.concat_ws("", F.col("close").cast("string"), F.when(F.col("id") % 7 == 0, F.lit("?"))).alias("close"), F.col("volume").cast("string").alias("volume"))
    return cleaning.prepared(raw, "seen_at", ["close", "volume"])


F02_SQL = "select id, open_time as seen_at, case when id % 7 <> 0 then close end as close, volume from btc_klines where open_time is not null"


def f03_first_delivery(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "btc_klines").select("feed_id", "timeframe", "open_time", "created_at", "id", "close")
    return cleaning.first_of_time(raw, ["feed_id", "timeframe"], "open_time", ["created_at", "id"])


F03_SQL = "select distinct feed_id, timeframe, open_time, created_at, id, close from btc_klines qualify dense_rank() over (partition by feed_id, timeframe, open_time order by created_at nulls first, id) = 1"


def f05_repaired_values(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.repaired_values(bars(spark, folder), KEYS), *cleaning.BARS)


_NEG = {c: f"case when k.{c} < 0 then greatest(m_{c}, 0.0001) else k.{c} end as {c}" for c in PRICES}
F05_SQL = f"""with a as (select k.feed_id, k.tf, k.open_time, k.id, {", ".join(_NEG.values())}, k.volume, s.*exclude (feed_id, tf), k.open as o0, k.high as h0, k.low as l0, k.close as c0 from {K} k join {STATS} s {ON}),
 b as (select *, case when high = 0 then coalesce(case when greatest(open, close) > 0 then greatest(open, close) end, m_high, 0.0001) else high end as hi, case when low = 0 then coalesce(case when least(open, close) > 0 then least(open, close) end, m_low, 0.0001) else low end as lo from a)
 select feed_id, tf, open_time, id, round(open, 6) as open, round(greatest(open, hi, lo, close), 6) as high, round(least(open, hi, lo, close), 6) as low, round(close, 6) as close,
 round(case when volume < 0 then m_volume when volume = 0 then coalesce(least_v, 0.01) else volume end, 6) as volume,
 case when greatest(open, hi, lo, close) > hi or least(open, hi, lo, close) < lo then 'envelope' when volume > mean_volume + 10 * sd_v then 'far_volume' when volume = 0 then 'no_volume' when volume < 0 then 'negative_volume' when h0 = 0 or l0 = 0 then 'zero_range' when least(o0, h0, l0, c0) < 0 then 'negative_price' end as repair from b"""


def f06_emptied_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.emptied_outliers(bars(spark, folder), KEYS, "open_time").select("feed_id", "tf", "open_time", *PRICES), *PRICES)


def _f06(c: str) -> str:
    outside = lambda f: f"(k.{c} > q3_{c} + {f} * (q3_{c} - q1_{c}) or k.{c} < greatest(q1_{c} - {f} * (q3_{c} - q1_{c}), 0))"
    return f"round(case when coalesce({outside(3)} and (not coalesce(abs(k.{c} / nullif(k.p_{c}, 0) - 1) > 0.5, false) or {outside(6)}), false) then null else k.{c} end, 6) as {c}"


F06_SQL = f"select k.feed_id, k.tf, k.open_time, {', '.join(map(_f06, PRICES))} from (select *, {', '.join(f'lag({c}) over {W} as p_{c}' for c in PRICES)} from {K}) k join {STATS} s {ON}"


def f07_column_report(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.column_report(table(spark, folder, "btc_klines"), [*cleaning.BARS, "turnover"])


F07_SQL = " union all ".join(f"select '{c}' as column_name, cast(1 as bigint) as present, count({c}) as known, count(*) filter ({c} < 0) as negative, count(*) filter (isinf({c})) as infinite from btc_klines" for c in cleaning.BARS) + " union all select 'turnover', cast(0 as bigint), null, null, null"


def f08_integrity_report(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.integrity_report(bars(spark, folder), KEYS, "open_time"))


_ISSUES = {
    "large_gap": "gap > 2 * step", "small_gap": "gap > 0 and gap < 0.1 * step", "repeated_time": "gap = 0", "high_below_low": "high < low", "outside_range": "open > high or close > high or open < low or close < low",
    "no_price": "open <= 0 or high <= 0 or low <= 0 or close <= 0", "no_volume": "volume = 0", "negative_volume": "volume < 0", "jump": "abs(close / nullif(before, 0) - 1) > 0.2", "volume_outlier": "away > 7.413 * mad", "null_value": "close is null or volume is null",
}
F08_SQL = f"""with a as (select *, epoch(open_time) - epoch(lag(open_time) over {W}) as gap, lag(close) over {W} as before from {K}), m as (select feed_id, tf, median(gap) as step, median(volume) as usual from a group by 1, 2),
 b as (select k.*, s.step, abs(k.volume - s.usual) as away from a k join m s {ON}), d as (select feed_id, tf, median(away) as mad from b group by 1, 2), x as (select k.*, s.mad from b k join d s {ON})
 {" union all ".join(f"select feed_id, tf, '{n}' as issue, count(*) as n, min(open_time) as first_at from x where {rule} group by 1, 2" for n, rule in _ISSUES.items())}"""


def f09_market_checks(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.market_checks(bars(spark, folder), KEYS, "open_time"))


F09_SQL = f"""with a as (select *, epoch(open_time) - epoch(lag(open_time) over {W}) as gap from {K}), g as (select feed_id, tf, gap, count(*) as n from a where gap is not null group by 1, 2, 3), m as (select feed_id, tf, sum(n) - max(n) as irregular from g group by 1, 2),
 s as (select feed_id, tf, count(*) as n_rows, count(*) filter (gap = 0) as repeated, count(*) filter (open is null or high is null or low is null or close is null or volume is null) as nulls, count(*) filter (high < low) as high_below_low,
  count(*) filter (open > high or close > high or open < low or close < low) as outside_range, count(*) filter (open <= 0 or high <= 0 or low <= 0 or close <= 0) as no_price from a group by 1, 2)
 select s.*, cast(coalesce(k.irregular, 0) as bigint) as irregular, cast(repeated + nulls + high_below_low + outside_range + no_price + coalesce(k.irregular, 0) = 0 as bigint) as passed from s left join m k {ON}"""


def f10_missing_periods(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.missing_periods(bars(spark, folder), KEYS, "open_time"))


F10_SQL = f"""with a as (select feed_id, tf, open_time, lag(open_time) over {W} as gap_start from {K}), g as (select *, cast(epoch(open_time) - epoch(gap_start) as bigint) as gap_s from a), m as (select feed_id, tf, median(gap_s) as step from g group by 1, 2)
 select k.feed_id, k.tf, gap_start, open_time as gap_end, gap_s, cast(round(gap_s / step) - 1 as bigint) as missing from g k join m s {ON} where gap_s > 1.5 * step"""


def m01_filled(spark: SparkSession, folder: str) -> DataFrame:
    """All four ways to fill the closes below one another."""
    rows = bars(spark, folder).select("feed_id", "tf", "open_time", "close")
    made = [cleaning.filled(rows, KEYS, "open_time", ["close"], m).withColumn("method", F.lit(m)) for m in ("interpolate", "ffill", "mean", "median")]
    made.append(cleaning.filled(rows, KEYS, "open_time", ["close"], "ffill", 2).withColumn("method", F.lit("ffill two")))
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return _out(out, "close")


M01_SQL = f"""with r as (select feed_id, tf, open_time, epoch(open_time) as s, close, row_number() over {W} as rn from {K}), known as (select * from r where close is not null),
 z as (select a.*, p.close as v0, p.s as t0, p.rn as r0 from r a asof left join known p on coalesce(a.feed_id, '') = coalesce(p.feed_id, '') and a.tf = p.tf and a.s >= p.s), y as (select a.*, n.close as v1, n.s as t1 from z a asof left join known n on coalesce(a.feed_id, '') = coalesce(n.feed_id, '') and a.tf = n.tf and a.s <= n.s),
 k as (select * from y), s as (select feed_id, tf, avg(close) as mu, median(close) as med from r group by 1, 2), x as (select k.*, s.mu, s.med from k join s {ON})
 select feed_id, tf, open_time, round(coalesce(close, case when t1 > t0 then v0 + (v1 - v0) * (s - t0) / (t1 - t0) end, v0, v1), 6) as close, 'interpolate' as method from x
 union all select feed_id, tf, open_time, round(v0, 6), 'ffill' from x union all select feed_id, tf, open_time, round(coalesce(close, mu), 6), 'mean' from x union all select feed_id, tf, open_time, round(coalesce(close, med), 6), 'median' from x
 union all select feed_id, tf, open_time, round(case when rn - r0 <= 2 then v0 end, 6), 'ffill two' from x"""


def r02_resampled_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Six hours from the first bar of each series."""
    return _out(resampling.resampled(bars(spark, folder), KEYS, "open_time", 21_600), *cleaning.BARS)


_AGG = "round(arg_min(open, open_time) filter (open is not null), 6) as open, round(max(high), 6) as high, round(min(low), 6) as low, round(arg_max(close, open_time) filter (close is not null), 6) as close, round(sum(volume), 6) as volume"
R02_SQL = f"with k as (select *, min(open_time) over (partition by feed_id, tf) as o from {K}) select feed_id, tf, o + to_seconds(21600 * cast(floor((epoch(open_time) - epoch(o)) / 21600) as bigint)) as open_time, arg_max(id, open_time) as id, {_AGG} from k group by 1, 2, 3"


def r04_weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    return _out(resampling.weekly(bars(spark, folder), KEYS, "open_time"), *cleaning.BARS)


R04_SQL = f"select feed_id, tf, cast(date_trunc('week', open_time) - interval 1 day as timestamp) as open_time, arg_max(id, open_time) as id, {_AGG} from {K} group by 1, 2, 3"


def r05_auto_resampled(spark: SparkSession, folder: str) -> DataFrame:
    """Four longer lengths that minutes make up, from 1970 on."""
    return _out(resampling.auto_resampled(bars(spark, folder), KEYS, "open_time", 60), *cleaning.BARS)


R05_SQL = " union all ".join(f"select feed_id, tf, time_bucket(interval {n} second, open_time, timestamp '1970-01-01 00:00:00') as open_time, arg_max(id, open_time) as id, {_AGG}, cast({n} as bigint) as length_s from {K} group by 1, 2, 3" for n in (300, 900, 3600, 14400))


def _days(spark: SparkSession, folder: str) -> DataFrame:
    days = resampling.resampled(bars(spark, folder), KEYS, "open_time", DAY, origin="epoch")
    return resampling.on_grid(days.withColumn("funding_rate", F.col("volume") / 7), KEYS, "open_time", DAY)


def m02_filled_days(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with a row for every day, filled by the class of each column."""
    return _out(cleaning.filled_by_class(_days(spark, folder), KEYS, "open_time"), *cleaning.BARS, "funding_rate")


def _m02(c: str) -> str:
    rn = lambda r: f"last_value(case when {c} is not null then {r} end ignore nulls) over {BACK}"
    nx = lambda r: f"first_value(case when {c} is not null then {r} end ignore nulls) over {AHEAD}"
    line = f"case when rn - {rn('rn')} <= 5 then {rn(c)} + ({nx(c)} - {rn(c)}) * (rn - {rn('rn')}) / nullif({nx('rn')} - {rn('rn')}, 0) end"
    return f"round(coalesce({c}, {line}, case when rn - {rn('rn')} <= 10 then {rn(c)} end, case when {nx('rn')} - rn <= 5 then {nx(c)} end), 6) as {c}"


M02_SQL = f"""with d as (select feed_id, tf, time_bucket(interval 1 day, open_time, timestamp '1970-01-01 00:00:00') as open_time, arg_max(id, open_time) as id, {_AGG.replace("round(", "(").replace(", 6)", ")")} from {K} group by 1, 2, 3),
 g as (select feed_id, tf, unnest(generate_series(min(open_time), max(open_time), interval 1 day)) as open_time from d group by 1, 2),
 f as (select g.*, d.id, d.open, d.high, d.low, d.close, d.volume, d.volume / 7 as funding_rate, row_number() over (partition by g.feed_id, g.tf order by g.open_time) as rn from g left join d on g.feed_id is not distinct from d.feed_id and g.tf = d.tf and g.open_time = d.open_time)
 select feed_id, tf, open_time, coalesce(last_value(id ignore nulls) over {BACK}, first_value(id ignore nulls) over {AHEAD}) as id, {", ".join(map(_m02, PRICES))}, round(coalesce(volume, 0), 6) as volume, round(coalesce(last_value(funding_rate ignore nulls) over {BACK}, 0), 6) as funding_rate from f"""


def m03_ohlc_normalized(spark: SparkSession, folder: str) -> DataFrame:
    rows, out = bars(spark, folder).drop("id"), None
    for m in ("zscore", "minmax", "robust"):
        one = cleaning.ohlc_normalized(rows, KEYS, m).select("feed_id", "tf", "open_time", *PRICES).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return _out(out, *PRICES, digits=5)


M03_SQL = f"""with s as (select feed_id, tf, avg(low) as mu, stddev_pop(low) as sd, min(low) as mn, max(low) as mx, median(low) as med, quantile_cont(low, 0.75) - quantile_cont(low, 0.25) as iq from {K} group by 1, 2), k as (select * from {K}),
 b as (select k.*, (low - mu) / nullif(sd, 0) + greatest(0, 0.01 - (mn - mu) / nullif(sd, 0)) as z, 0.01 + 0.99 * (low - mn) / nullif(mx - mn, 0) as m, (low - med) / nullif(iq, 0) + greatest(0, 0.01 - (mn - med) / nullif(iq, 0)) as r from k join s {ON})
 {" union all ".join(f"select feed_id, tf, open_time, {', '.join(f'round({x}, 5) as low' if c == 'low' else f'round({x} * ({c} / nullif(low, 0)), 5) as {c}' for c in PRICES)}, '{n}' as method from b" for x, n in (("z", "zscore"), ("m", "minmax"), ("r", "robust")))}"""


def m04_scaled_volume(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.scaled_non_negative(bars(spark, folder).select("feed_id", "tf", "open_time", "volume"), KEYS, "volume", "zscore").drop("volume"), "volume_scaled")


M04_SQL = f"select k.feed_id, k.tf, k.open_time, round((k.volume - lo) / nullif(sd, 0), 6) as volume_scaled from {K} k join (select feed_id, tf, min(volume) as lo, stddev_pop(volume) as sd from {K} group by 1, 2) s {ON}"


def m06_doubles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_quantity").cast("decimal(12,2)").alias("l_quantity"), F.col("l_extendedprice").cast("decimal(14,3)").alias("l_extendedprice"), "l_returnflag")
    return cleaning.as_doubles(rows)


M06_SQL = "select l_orderkey::double as l_orderkey, l_quantity::decimal(12,2)::double as l_quantity, l_extendedprice::decimal(14,3)::double as l_extendedprice, l_returnflag from lineitem"


def m07_anomaly_ready(spark: SparkSession, folder: str) -> DataFrame:
    return _out(cleaning.anomaly_ready(bars(spark, folder).select("feed_id", "tf", "open_time", "close", "volume"), KEYS, "open_time", ["close", "volume"]), "close", "volume", "close_log", "volume_log")


M07_SQL = f"""with m as (select feed_id, tf, median(close) as mc, median(volume) as mv from {K} group by 1, 2), f as (select k.feed_id, k.tf, k.open_time, coalesce(k.close, s.mc) as close, coalesce(k.volume, s.mv) as volume from {K} k join m s {ON}),
 g as (select feed_id, tf, case when count(close) > 2 and min(close) < max(close) then skewness(close) end as kc, case when count(volume) > 2 and min(volume) < max(volume) then skewness(volume) end as kv, min(close) as lc, min(volume) as lv from f group by 1, 2)
 select k.feed_id, k.tf, k.open_time, round(k.close, 6) as close, round(k.volume, 6) as volume, round(case when abs(kc) > 1.5 and lc >= 0 then ln(1 + k.close) end, 6) as close_log, round(case when abs(kv) > 1.5 and lv >= 0 then ln(1 + k.volume) end, 6) as volume_log from f k join g s {ON}"""


def m08_without_nulls(spark: SparkSession, folder: str) -> DataFrame:
    rows = bars(spark, folder).select("feed_id", "tf", "open_time", "close", "volume", F.when(F.col("volume") > 0, 1).cast("long").alias("traded"))
    carried = cleaning.without_nulls(rows, KEYS, "open_time", ["close", "volume", "traded"], ["traded"])
    middle = cleaning.without_nulls(rows, KEYS, "open_time", ["close", "volume", "traded"], ["traded"], "median")
    return _out(carried.withColumn("policy", F.lit("carry")).unionByName(middle.withColumn("policy", F.lit("median"))), "close", "volume")


M08_SQL = f"""with k as (select *, cast(case when volume > 0 then 1 else 0 end as bigint) as traded from {K}), s as (select feed_id, tf, median(close) as mc, median(volume) as mv from k group by 1, 2)
 select feed_id, tf, open_time, {", ".join(f"round(coalesce(last_value({c} ignore nulls) over {BACK}, first_value({c} ignore nulls) over {AHEAD}, 0), 6) as {c}" for c in ("close", "volume"))}, traded, 'carry' as policy from k
 union all select k.feed_id, k.tf, k.open_time, round(coalesce(k.close, mc, 0), 6), round(coalesce(k.volume, mv, 0), 6), traded, 'median' from k join s {ON}"""

TWINS = {
    "f02_prepared": F02_SQL, "f03_first_delivery": F03_SQL, "f05_repaired_values": F05_SQL, "f06_emptied_outliers": F06_SQL, "f07_column_report": F07_SQL, "f08_integrity_report": F08_SQL, "f09_market_checks": F09_SQL,
    "f10_missing_periods": F10_SQL, "m01_filled": M01_SQL, "m02_filled_days": M02_SQL, "m03_ohlc_normalized": M03_SQL, "m04_scaled_volume": M04_SQL, "m06_doubles": M06_SQL, "m07_anomaly_ready": M07_SQL,
    "m08_without_nulls": M08_SQL, "r02_resampled_bars": R02_SQL, "r04_weekly_bars": R04_SQL, "r05_auto_resampled": R05_SQL,
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in TWINS}


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
