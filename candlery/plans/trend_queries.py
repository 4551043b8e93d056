"""Trend operators over four-hour bars of the events, with DuckDB twins written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators import recursive, trend
from candlery.plans.candle_queries import FOUR_HOURS_SQL, four_hours

Query = Callable[[SparkSession, str], DataFrame]
W = "partition by symbol order by open_time"
SO_FAR = f"({W} rows unbounded preceding)"


def _ema(values: str, n: int, alpha: str | None = None) -> str:
    """A fold over the list: the mean of the first n values, then one value after the other."""
    return f"case when len({values}) >= {n} then list_reduce(list_prepend(list_avg({values}[1:{n}]), {values}[{n + 1}:]), lambda a, x: a + (x - a) * {alpha or f'2.0 / {n + 1}'}) end"


def _mean(x: str, n: int) -> str:
    return f"case when count({x}) over ({W} rows {n - 1} preceding) = {n} then avg({x}) over ({W} rows {n - 1} preceding) end"


_LISTS = f"""b as (select *, lag({{'c': close, 'h': high, 'l': low}}) over ({W}) as p, row_number() over ({W}) as rn from ({FOUR_HOURS_SQL})),
 t as (select *, greatest(high - low, abs(high - p.c), abs(low - p.c)) as tr, close - p.c as mv from b),
 l as (select *, list(close) over {SO_FAR} as cs, list(tr) over {SO_FAR} as trs, list_filter(list(mv) over {SO_FAR}, lambda v: v is not null) as ms from t),
 e as (select *, {", ".join(f"{_ema('cs', n)} as ema_{n}" for n in (5, 10, 12, 20, 26, 50, 200))}, {", ".join(f"{_ema(f'list_transform(ms, lambda v: greatest({s}v, 0))', n, f'1.0 / {n}')} as {k}_{n}" for n in (7, 14, 21) for k, s in (("up", ""), ("dn", "-")))},
  {", ".join(f"{_ema('trs', n, f'1.0 / {n}')} as atr_{n}" for n in (10, 14, 20))} from l),
 m as (select *, ema_12 - ema_26 as macd from e), g as (select *, {_ema(f"list_filter(list(macd) over {SO_FAR}, lambda v: v is not null)", 9)} as macd_signal from m)"""


def _ewm(span: int) -> str:
    w = f"list_transform(range(1, len(cs) + 1), lambda i: pow({1 - 2 / (span + 1)!r}, len(cs) - i))"
    return f"{w} as w{span}, list_dot_product({w}, cs) / list_sum({w}) as mu{span}"


def _ewm_out(s: int) -> str:
    var = f"case when rn > 1 then list_sum(list_transform(range(1, len(cs) + 1), lambda i: w{s}[i] * pow(cs[i] - mu{s}, 2))) / list_sum(w{s}) * pow(list_sum(w{s}), 2) / (pow(list_sum(w{s}), 2) - list_dot_product(w{s}, w{s})) end"
    return f"round(mu{s}, 5) as ewm_mean_{s}, round(sqrt({var}), 5) as ewm_std_{s}, round({var}, 3) as ewm_var_{s}"


T02_SQL = f"""with {_LISTS} select symbol, open_time, {", ".join(f"round(ema_{n}, 6) as ema_{n}" for n in (5, 10, 20, 50, 200))}, {", ".join(f"round(100 * up_{n} / nullif(up_{n} + dn_{n}, 0), 6) as rsi_{n}" for n in (7, 14, 21))},
 round(macd, 6) as macd, round(macd_signal, 6) as macd_signal, round(macd - macd_signal, 6) as macd_hist, round(atr_14, 6) as atr_14, round(ema_20 + 2 * atr_20, 6) as keltner_upper, round(ema_20 - 2 * atr_20, 6) as keltner_lower from g"""
W03_SQL = f"with {_LISTS}, x as (select symbol, open_time, rn, cs, {', '.join(map(_ewm, (7, 14, 30)))} from l) select symbol, open_time, {', '.join(map(_ewm_out, (7, 14, 30)))} from x"
T15_SQL = f"""with recursive {_LISTS}, r as (select symbol, open_time, rn, close, p.c as pc, (high + low) / 2 + 3 * atr_10 as ru, (high + low) / 2 - 3 * atr_10 as rd from g where atr_10 is not null),
 s as (select symbol, open_time, rn, close, ru as u, rd as d, case when close < rd then -1 else 1 end as side from r where rn = 10
  union all select r.symbol, r.open_time, r.rn, r.close, case when r.ru < s.u or r.pc > s.u then r.ru else s.u end, case when r.rd > s.d or r.pc < s.d then r.rd else s.d end,
   case when r.close > case when r.ru < s.u or r.pc > s.u then r.ru else s.u end then 1 when r.close < case when r.rd > s.d or r.pc < s.d then r.rd else s.d end then -1 else s.side end from s join r on r.symbol = s.symbol and r.rn = s.rn + 1)
 select b.symbol, b.open_time, round(case when side = 1 then d else u end, 6) as supertrend, cast(side as double) as supertrend_side from b left join s on b.symbol = s.symbol and b.rn = s.rn"""

_FRAME = f"""{_LISTS},
 d1 as (select *, high - p.h as um, p.l - low as dm, case when rn >= 14 then list_avg(trs[-14:]) end as atr, {", ".join(f"{_mean('close', n)} as sma{n}" for n in (7, 14, 20))}, case when rn >= 20 then stddev_samp(close) over ({W} rows 19 preceding) end as sd20, avg(close) over {SO_FAR} as mean_close,
  {_mean("volume", 20)} as v20, avg(volume) over ({W} rows 4 preceding) as v5, abs(close - open) as body, regr_r2(close, rn) over {SO_FAR} as r2, regr_slope(close, rn) over {SO_FAR} as slope,
  case when rn >= 15 then list(high) over ({W} rows 14 preceding) end as h15, case when rn >= 15 then list(low) over ({W} rows 14 preceding) end as l15, 100 * up_14 / nullif(up_14 + dn_14, 0) as rsi, macd - macd_signal as hist from g),
 d2 as (select *, case when um is null then null when um > dm and um > 0 then um else 0 end as pdm, case when um is null then null when dm > um and dm > 0 then dm else 0 end as mdm, 400 * sd20 / nullif(sma20, 0) as bbw from d1),
 d3 as (select *, 100 * {_mean("pdm", 14)} / nullif(atr, 0) as pdi, 100 * {_mean("mdm", 14)} / nullif(atr, 0) as mdi from d2), d4 as (select *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) as dx from d3), fr as (select *, {_mean("dx", 14)} as adx from d4)"""

_VOTE = f"""v as (select symbol, open_time, case when adx >= 25 then 0.3 else 0.3 * adx / 25 end * adx / 100 as wa, pdi > mdi as sa,
  case when (close > sma7 and sma7 > sma14) or (close < sma7 and sma7 < sma14) then 0.25 else 0.0625 end * least(1.0, 10 * abs(sma7 - sma14) / nullif(sma14, 0)) as ws, close > sma14 as ss,
  case when hist <> 0 then 0.25 else 0.0225 end * least(1.0, 1000 * abs(hist) / nullif(mean_close, 0)) as wm, macd > macd_signal as sm,
  case when rsi > 70 or rsi < 30 then 0.14 when rsi > 55 or rsi < 45 then 0.1 else 0 end * abs(rsi - 50) / 50 as wr, rsi > 50 as sr from fr),
 u as (select symbol, open_time, {" + ".join(f"coalesce(case when s{k} then w{k} end, 0)" for k in "asmr")} as up_score, {" + ".join(f"coalesce(case when not s{k} then w{k} end, 0)" for k in "asmr")} as down_score from v),
 vote as (select *, case when up_score > down_score + 0.05 and up_score >= 0.15 then 'uptrend' when down_score > up_score + 0.05 and down_score >= 0.15 then 'downtrend' when up_score >= 0.15 or down_score >= 0.15 then 'sideways' else 'unknown' end as trend from u)"""
_STRENGTH = f"""c as (select *, list(body) over ({W} rows 2 preceding) as b3, list(sign(close - open)) over ({W} rows 2 preceding) as s3 from fr),
 strong as (select symbol, open_time, case when rn < 20 then 0 else least(1, greatest(0, 0.25 * coalesce(least(1, adx / 100) + 0 * adx, 0.5) + 0.15 * coalesce(r2, 0) + 0.15 * coalesce(abs(list_position(h15, list_max(h15)) - list_position(l15, list_min(l15))) / 14.0, 0.5)
  + 0.15 * coalesce(least(1, 100 * abs(macd) / nullif(mean_close, 0)) + 0 * macd, 0) + 0.1 * case when rsi >= 70 or rsi <= 30 then least(1, greatest(0, (abs(rsi - 50) - 20) / 30)) else 0.2 end + 0.1 * coalesce(1 - least(1, 20 * atr / nullif(close, 0)) + 0 * atr, 0.5)
  + 0.05 * case when list_avg(b3) > 0 and list_min(b3) > 0.8 * list_avg(b3) and slope <> 0 and len(list_filter(s3, lambda v: v = sign(slope))) = 3 then 0.2 else 0 end + 0.05 * coalesce(least(1, v5 / nullif(v20, 0) / 2) + 0 * v20, 0.5))) end as strength from c)"""
_REGIME = f"""n1 as (select *, case when adx is not null and bbw is not null and rsi is not null then 100 * atr / nullif(close, 0) end as nv, case when adx is not null and bbw is not null and rsi is not null then bbw end as bw from fr),
 n2 as (select *, list_filter(list(nv) over ({W} rows 99 preceding), lambda x: x is not null) as hundred, avg(nv) over ({W} rows 19 preceding) as recent, avg(bw) over ({W} rows 9 preceding) / nullif(avg(bw) over ({W} rows 99 preceding), 0) as width from n1),
 n3 as (select *, list_aggregate(hundred, 'quantile_cont', 0.25) as q1, list_aggregate(hundred, 'quantile_cont', 0.75) as q3, case when pdi > mdi then 'up' else 'down' end as way from n2),
 regime as (select symbol, open_time, case when rn < 50 or nv is null or len(hundred) < 20 then 'insufficient_data' when adx > 30 and recent > q3 then 'strong_' || way || 'trend_high_volatility' when adx > 30 then 'strong_' || way || 'trend_normal_volatility'
  when adx > 20 and width > 1.1 then 'emerging_' || way || 'trend' when adx > 20 then 'moderate_trend' when width < 0.9 and (rsi > 60 or rsi < 40) then 'accumulation_before_breakout' when width < 0.9 then 'consolidation' when recent < q1 then 'low_volatility_sideways'
  when width > 1.1 and recent > q3 then 'high_volatility_range' else 'choppy_market' end as regime from n3)"""


def t02_recursive_indicators(spark: SparkSession, folder: str) -> DataFrame:
    found = recursive.recursive_indicators(four_hours(spark, folder))
    names = [n for n in recursive.NAMES if not n.startswith(("supertrend", "psar", "ewm_"))]
    return found.select("symbol", "open_time", *[F.round(n, 6).alias(n) for n in names])


def w03_exponential(spark: SparkSession, folder: str) -> DataFrame:
    found = recursive.recursive_indicators(four_hours(spark, folder))
    return found.select("symbol", "open_time", *[F.round(n, 3 if "_var_" in n else 5).alias(n) for n in recursive.NAMES if n.startswith("ewm_")])


def t15_supertrend(spark: SparkSession, folder: str) -> DataFrame:
    return recursive.recursive_indicators(four_hours(spark, folder)).select("symbol", "open_time", F.round("supertrend", 6).alias("supertrend"), "supertrend_side")


def t14_parabolic_sar(spark: SparkSession, folder: str) -> DataFrame:
    return recursive.recursive_indicators(four_hours(spark, folder)).select("symbol", "open_time", F.round("psar", 6).alias("psar"))


def r20_trend_vote(spark: SparkSession, folder: str) -> DataFrame:
    found = trend.trend_vote(trend.trend_frame(four_hours(spark, folder)))
    return found.select("symbol", "open_time", F.round("up_score", 5).alias("up_score"), F.round("down_score", 5).alias("down_score"), "trend")


def r21_trend_strength(spark: SparkSession, folder: str) -> DataFrame:
    return trend.trend_strength(trend.trend_frame(four_hours(spark, folder))).withColumn("strength", F.round("strength", 6))


def r22_market_regime(spark: SparkSession, folder: str) -> DataFrame:
    return trend.market_regime(trend.trend_frame(four_hours(spark, folder)))


def r23_divergences(spark: SparkSession, folder: str) -> DataFrame:
    return trend.divergences(trend.trend_frame(four_hours(spark, folder)), "rsi_14")


R23_SQL = f"""with {_FRAME}, x as (select symbol, rn, open_time, close, rsi from fr),
 ext as (select a.symbol, a.rn, a.open_time, a.close as v, 'price' as what, case when count(*) filter (n.close < a.close) = 10 then 1 when count(*) filter (n.close > a.close) = 10 then -1 end as side from x a join x n on a.symbol = n.symbol and n.rn <> a.rn and abs(n.rn - a.rn) <= 5 group by all
  union all select a.symbol, a.rn, a.open_time, a.rsi, 'rsi', case when count(*) filter (n.rsi < a.rsi) = 10 then 1 when count(*) filter (n.rsi > a.rsi) = 10 then -1 end from x a join x n on a.symbol = n.symbol and n.rn <> a.rn and abs(n.rn - a.rn) <= 5 group by all),
 q as (select p.symbol, p.rn, p.open_time, p.v, p.side, (select i.v from ext i where i.what = 'rsi' and i.symbol = p.symbol and i.side = p.side and abs(i.rn - p.rn) < 3 order by abs(i.rn - p.rn), i.rn limit 1) as o from ext p where p.what = 'price' and p.side is not null),
 k as (select *, lag(v) over w as v0, lag(o) over w as o0, lag(open_time) over w as first_at from q window w as (partition by symbol, side order by rn))
 select symbol, first_at, open_time as second_at, case when side = 1 then case when v > v0 and o < o0 then 'regular_bearish' when v < v0 and o > o0 then 'hidden_bearish' end else case when v < v0 and o > o0 then 'regular_bullish' when v > v0 and o < o0 then 'hidden_bullish' end end as kind from k
 where (v > v0 and o < o0) or (v < v0 and o > o0)"""


def r24_trend_summary(spark: SparkSession, folder: str) -> DataFrame:
    return trend.trend_summary(four_hours(spark, folder)).withColumn("strength", F.round("strength", 6))


R24_SQL = f"""with {_FRAME}, {_VOTE}, {_STRENGTH}, {_REGIME} select symbol, open_time, trend, round(strength, 6) as strength, regime,
 'The ' || case when strength >= 0.7 then 'strong' when strength >= 0.4 then 'moderate' else 'weak' end || ' trend is ' || trend || ', the regime ' || replace(regime, '_', ' ') || '.' as summary
 from vote join strong using (symbol, open_time) join regime using (symbol, open_time) qualify row_number() over (partition by symbol order by open_time desc) = 1"""


def r25_trend_sequences(spark: SparkSession, folder: str) -> DataFrame:
    found = trend.trend_sequences(four_hours(spark, folder))
    return found.select("symbol", "open_time", F.concat_ws(",", F.transform("closes", lambda x: F.format_number(x, 4))).alias("closes"), F.col("regime_code").cast("long").alias("regime_code"))


_CODES = " ".join(f"when '{r}' then {i}" for i, r in enumerate(trend.REGIMES))
R25_SQL = f"""with {_FRAME}, {_REGIME}, y as (select symbol, open_time, rn, (close - min(low) over {SO_FAR}) / nullif(max(high) over {SO_FAR} - min(low) over {SO_FAR}, 0) as x from b),
 z as (select symbol, open_time, list(x) over ({W} rows 29 preceding) as xs, rn from y) select symbol, open_time, array_to_string(list_transform(xs, lambda v: format('{{:.4f}}', v)), ',') as closes, cast(case regime {_CODES} end as bigint) as regime_code from z join regime using (symbol, open_time) where len(list_filter(xs, lambda v: v is not null)) = 30"""


def r26_price_levels(spark: SparkSession, folder: str) -> DataFrame:
    return trend.price_levels(four_hours(spark, folder)).withColumn("level", F.round("level", 6))


_LEVELS = f"""b as (select *, row_number() over ({W}) as rn, count(*) over (partition by symbol) as total from ({FOUR_HOURS_SQL})),
 mk as (select symbol, 'resistance' as kind, high as price from b qualify rn > 5 and rn <= total - 5 and high = max(high) over ({W} rows between 5 preceding and 5 following) union all select symbol, 'support', low from b qualify rn > 5 and rn <= total - 5 and low = min(low) over ({W} rows between 5 preceding and 5 following)),
 o as (select *, row_number() over (partition by symbol, kind order by price) as k from mk),
 f as (select symbol, kind, k, price, price as first_price, 1 as grp from o where k = 1 union all select o.symbol, o.kind, o.k, o.price, case when o.price <= f.first_price * 1.02 then f.first_price else o.price end, case when o.price <= f.first_price * 1.02 then f.grp else f.grp + 1 end from f join o on o.symbol = f.symbol and o.kind = f.kind and o.k = f.k + 1),
 lv as (select symbol, kind, avg(price) as level, count(*) as touches from f group by symbol, kind, grp having count(*) >= 3)"""
R26_SQL = f"with recursive {_LEVELS} select symbol, kind, round(level, 6) as level, touches from lv"


def r27_breakouts(spark: SparkSession, folder: str) -> DataFrame:
    bars = four_hours(spark, folder)
    found = trend.breakouts(bars, trend.price_levels(bars))
    return found.withColumns({c: F.round(c, 6) for c in ("level", "strength", "volume_change")})


R27_SQL = f"""with recursive {_LEVELS}, x as (select *, lag(close) over ({W}) as pc, avg(volume) over ({W} rows between 20 preceding and 1 preceding) as usual from b)
 select symbol, open_time, round(level, 6) as level, case when pc < level then 'up' else 'down' end as kind, round(abs(close / nullif(level, 0) - 1), 6) as strength, round(volume / nullif(usual, 0) - 1, 6) as volume_change from x join lv using (symbol)
 where (pc < level and high > level and close > level * 1.001) or (pc > level and low < level and close < level * 0.999)"""


def y10_projected_turns(spark: SparkSession, folder: str) -> DataFrame:
    return trend.projected_turns(four_hours(spark, folder))


Y10_SQL = f"""with x as (select symbol, open_time, high, low, list({{'h': high, 'l': low}}) over ({W} rows between 10 preceding and 1 preceding) as p from ({FOUR_HOURS_SQL})),
 y as (select symbol, open_time, case when high > list_max(list_transform(p, lambda e: e.h)) then 'top' when low < list_min(list_transform(p, lambda e: e.l)) then 'bottom' end as kind from x where len(p) = 10) select * from y where kind is not null"""

def z02_six_signals(spark: SparkSession, folder: str) -> DataFrame:
    return trend.six_signals(four_hours(spark, folder))


_SIDES = {
    "s_means": ("s9 > sma20", "s9 < sma20"), "s_rsi": ("rsi < 30", "rsi > 70"), "s_macd": ("macd > macd_signal", "macd < macd_signal"), "s_stochastic": ("k < 20 and d < 20 and k > d", "k > 80 and d > 80 and k < d"),
    "s_bands": ("close < sma20 - 2 * sd20", "close > sma20 + 2 * sd20"), "s_adx": ("adx > 25 and pdi > mdi", "adx > 25 and pdi < mdi"),
}
Z02_SQL = f"""with {_FRAME}, k0 as (select *, {_mean("close", 9)} as s9, case when rn >= 14 then 100 * (close - min(low) over ({W} rows 13 preceding)) / nullif(max(high) over ({W} rows 13 preceding) - min(low) over ({W} rows 13 preceding), 0) end as raw from fr),
 k1 as (select *, {_mean("raw", 3)} as k from k0), k2 as (select *, {_mean("k", 3)} as d from k1), v as (select symbol, open_time, {", ".join(f"case when {a} then 1 when {b} then -1 else 0 end as {n}" for n, (a, b) in _SIDES.items())} from k2),
 c as (select *, {" + ".join(f"cast({n} = 1 as int)" for n in _SIDES)} as good, {" + ".join(f"cast({n} = -1 as int)" for n in _SIDES)} as bad from v) select *, cast(sign(good - bad) as int) as majority from c"""


def r10_chart_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """With a wider tolerance than prices need, since the values of events are no prices."""
    found = trend.chart_patterns(four_hours(spark, folder), alike=0.3, flat=0.6)
    return found.withColumns({c: F.round(c, 6) for c in ("level", "strength")})


R10_SQL = f"""with b as (select *, row_number() over ({W}) as rn from ({FOUR_HOURS_SQL})), n as (select a.symbol, a.rn, count(*) as k, max(o.high) as hi, min(o.low) as lo from b a join b o on o.symbol = a.symbol and o.rn <> a.rn and abs(o.rn - a.rn) <= 5 group by 1, 2),
 s as (select symbol, open_time, 'top' as side, high as v from b join n using (symbol, rn) where k = 10 and high > hi union all select symbol, open_time, 'bottom', low from b join n using (symbol, rn) where k = 10 and low < lo),
 p as (select *, lead(v) over (partition by symbol, side order by open_time) as w, lead(open_time) over (partition by symbol, side order by open_time) as t from s),
 q as (select p.*, (select case p.side when 'top' then min(m.v) else max(m.v) end from s m where m.symbol = p.symbol and m.side <> p.side and m.open_time > p.open_time and m.open_time < p.t) as mid from p where abs(v - w) < 0.3 * (v + w) / 2),
 d as (select *, case side when 'top' then greatest(v, w) / nullif(mid, 0) - 1 else mid / nullif(least(v, w), 0) - 1 end as move from q),
 l as (select symbol, side, list(v order by open_time) as vs, min(open_time) as a, max(open_time) as z from (select *, row_number() over (partition by symbol, side order by open_time desc) as r from s) where r <= 3 group by 1, 2 having count(*) >= 2),
 j as (select h.symbol, h.vs as hs, o.vs as ls, least(h.a, o.a) as a, greatest(h.z, o.z) as z from l h join l o on h.symbol = o.symbol and h.side = 'top' and o.side = 'bottom')
 select symbol, 'double_' || side as kind, open_time as start_at, t as end_at, round(mid, 6) as level, round(least(1, 20 * move), 6) as strength from d where move > 0.02
 union all select symbol, 'ascending_triangle', a, z, round(list_avg(hs), 6), 0.7 from j where (list_max(hs) - list_min(hs)) / list_avg(hs) < 0.6 and ls = list_sort(ls) union all select symbol, 'descending_triangle', a, z, round(list_avg(ls), 6), 0.7 from j where (list_max(ls) - list_min(ls)) / list_avg(ls) < 0.6 and hs = list_reverse_sort(hs)"""
TWINS = {
    "t02_recursive_indicators": T02_SQL, "w03_exponential": W03_SQL, "t15_supertrend": T15_SQL, "t14_parabolic_sar": "", "r20_trend_vote": f"with {_FRAME}, {_VOTE} select symbol, open_time, round(up_score, 5) as up_score, round(down_score, 5) as down_score, trend from vote",
    "r21_trend_strength": f"with {_FRAME}, {_STRENGTH} select symbol, open_time, round(strength, 6) as strength from strong", "r22_market_regime": f"with {_FRAME}, {_REGIME} select * from regime", "r23_divergences": R23_SQL,
    "r24_trend_summary": R24_SQL, "r25_trend_sequences": R25_SQL, "r26_price_levels": R26_SQL, "r27_breakouts": R27_SQL, "y10_projected_turns": Y10_SQL, "r10_chart_patterns": R10_SQL, "z02_six_signals": Z02_SQL,
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in TWINS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in TWINS.items() if sql}
