"""DuckDB twins of candle operators, written from the formulas and not from the operators' own text.

Windows are lists of the last n values here, folded by list functions; earlier bars are structs. {b} stands for the bars.
"""

from __future__ import annotations

W = "partition by symbol order by open_time"


def _last(n: int, x: str) -> str:
    """The last n values of x, null while there are fewer rows."""
    return f"case when count(*) over ({W} rows {n - 1} preceding) = {n} then list({x}) over ({W} rows {n - 1} preceding) end"


def _flags(rules: dict[str, str]) -> str:
    return ", ".join(f"cast(coalesce({rule}, false) as bigint) as {name}" for name, rule in rules.items())


K01 = f"""with x as (select *, abs(close - open) as body, high - low as rng, high - case when open > close then open else close end as us, case when open < close then open else close end - low as ls,
  case when close > open then 1 when close < open then -1 when close = open then 0 end as d, abs(close - open) / nullif(high - low, 0) as rel from {{b}}),
 y as (select *, lag({{'o': open, 'c': close, 'h': high, 'l': low, 'd': d, 'rel': rel, 'body': body}}) over ({W}) as p, lag({{'o': open, 'c': close, 'd': d}}, 2) over ({W}) as q,
  {_last(20, "body")} as bodies, {_last(20, "rng")} as rngs, {_last(6, "low")} as lows, {_last(6, "high")} as highs from x)
 select symbol, open_time, round(body, 6) as body, round(rng, 6) as rng, round(us, 6) as upper_shadow, round(ls, 6) as lower_shadow, cast(d as bigint) as direction, round(rel, 6) as rel_body,
 round(rng / nullif(list_avg(rngs), 0), 6) as rel_candle, """ + _flags(
    {
        "doji": "rel < 0.1",
        "hammer": "rel < 0.3 and ls > 2 * body and us < ls / 5",
        "inverted_hammer": "rel < 0.3 and us > 2 * body and ls < us / 5",
        "long_candle": "body > 1.5 * list_avg(bodies)",
        "marubozu": "us < rng / 20 and ls < rng / 20 and rel > 0.9",
        "high_wave": "rel < 0.3 and greatest(us, ls) > 3 * body",
        "firefly": "rel < 0.25 and us < rng / 10 and ls > 2.5 * body",
        "bullish_engulfing": "p.c < p.o and close > open and p.c > open and p.o < close",
        "bearish_engulfing": "p.c > p.o and close < open and p.c < open and p.o > close",
        "morning_star": "q.c < q.o and p.rel < 0.3 and close > open and 2 * close > q.o + q.c",
        "evening_star": "q.c > q.o and p.rel < 0.3 and close < open and 2 * close < q.o + q.c",
        "three_white_soldiers": "q.c > q.o and p.c > p.o and close > open and close > p.c and p.c > q.c",
        "three_black_crows": "q.c < q.o and p.c < p.o and close < open and close < p.c and p.c < q.c",
        "doji_star": "p is not null and rel < 0.1 and not coalesce(p.rel < 0.1, false)",
        "top_pinbar": "abs(high - p.h) < high * 0.001 and p.d != d",
        "bottom_pinbar": "abs(low - p.l) < low * 0.001 and p.d != d",
        "bullish_harami": "p.c < p.o and close > open and open > p.c and close < p.o and body < p.body * 0.6",
        "bearish_harami": "p.c > p.o and close < open and open < p.c and close > p.o and body < p.body * 0.6",
        "ascending_triangle": "low > list_min(lows[1:5]) and abs(high - list_max(highs[1:5])) < high * 0.001",
        "descending_triangle": "high < list_max(highs[1:5]) and abs(low - list_min(lows[1:5])) < low * 0.001",
    }
) + " from y"

_FIB = [(level, n) for n in (55, 89) for level in (0.236, 0.382, 0.5, 0.618, 0.786)]


def _around(n: int) -> str:
    return f"list(close) over ({W} rows between {n // 2} preceding and {n - 1 - n // 2} following)"


C01 = f"""with x as (select *, {_around(21)} as a21, {_around(34)} as a34, {_around(5)} as a5, {_last(55, "close")} as l55, {_last(89, "close")} as l89, {_last(90, "close")} as l90, lag(close, 24) over ({W}) as c24,
 {", ".join(f"{_last(n, '{x: high, y: low}')} as hl{n}" for n in (14, 21))}, {", ".join(f"{_last(n + 1, 'close')} as s{n}" for n in (7, 14, 30))} from {{b}})
 select symbol, open_time, """ + _flags(
    {f"local_max_{n}": f"len(a{n}) = {n} and close = list_max(a{n})" for n in (21, 34)}
    | {f"local_min_{n}": f"len(a{n}) = {n} and close = list_min(a{n})" for n in (21, 34)}
    | {"fractal_high": "len(a5) = 5 and a5[3] = list_max(a5) and a5[1] <> a5[3] and a5[5] <> a5[3]", "fractal_low": "len(a5) = 5 and a5[3] = list_min(a5) and a5[1] <> a5[3] and a5[5] <> a5[3]"}
    | {f"near_fib_{str(level).replace('.', '_')}_{n}": f"abs(close - (list_min(l{n}) + {level} * (list_max(l{n}) - list_min(l{n})))) < close / 200" for level, n in _FIB}
) + """, round(abs(close / nullif(c24, 0) - 1), 6) as daily_range_ratio, round(volume / nullif(close, 0), 6) as volume_price_ratio, round((list_position(l90, list_max(l90)) - 1) / 89.0, 6) as cycle_position_90,
 """ + ", ".join(f"round(list_avg(list_transform(hl{n}, lambda e: e.x - e.y)) / nullif(list_max(list_transform(hl{n}, lambda e: e.x)) - list_min(list_transform(hl{n}, lambda e: e.y)), 0), 6) as consolidation_{n}" for n in (14, 21)) + """,
 """ + ", ".join(f"round(abs(list_sum(list_transform(range(1, {n + 1}), lambda i: sign(s{n}[i + 1] - s{n}[i])))) / {n}.0, 6) as trend_strength_{n}" for n in (7, 14, 30)) + " from x"

Y04 = f"""with x as (select *, {_last(10, "close")} as l10, {_last(15, "close")} as l15, {_last(30, "close")} as l30, {_last(15, "volume")} as v15, lag(close, 7) over ({W}) as c7, coalesce(close - lag(close) over ({W}), 0) as move from {{b}}),
 y as (select *, list_avg(l10) as fast, list_avg(l30) as slow, close / nullif(c7, 0) - 1 as mom, list_stddev_samp(l15) / nullif(close, 0) as cv, {_last(14, "move")} as moves from x),
 z as (select *, list_avg(list_transform(moves, lambda m: greatest(m, 0))) as up, list_avg(list_transform(moves, lambda m: greatest(-m, 0))) as down, {_last(60, "cv")} as cvs from y),
 k as (select *, 100 - 100 / (1 + up / case when down = 0 then 0.00001 else down end) as rsi, abs(mom) < 0.05 and len(list_filter(cvs, lambda v: v is not null)) = 60 and cv < list_avg(cvs) as calm from z)
 select symbol, open_time, cast(case when fast < slow and mom < 0 then 4 when fast > slow and calm and rsi > 50 then 3 when fast > slow and mom > 0 and volume > list_avg(v15) then 2 when fast < slow and calm and rsi < 50 then 1 else 0 end as bigint) as phase from k"""

# a fold over the bars of a symbol, one after the other
Y05 = """with recursive n as (select *, row_number() over (partition by symbol order by open_time) as rn from {b}),
 s as (select symbol, rn, open_time, close, close as lo, close as hi, 0.0::double as rise, 0.0::double as fall, null::int as state, 0 as no from n where rn = 1
  union all select n.symbol, n.rn, n.open_time, n.close, least(s.lo, n.close), greatest(s.hi, n.close), n.close / nullif(least(s.lo, n.close), 0) - 1, n.close / nullif(greatest(s.hi, n.close), 0) - 1,
   case when s.state is null then case when n.close / nullif(least(s.lo, n.close), 0) - 1 >= 0.2 then 1 end
    when n.close / nullif(least(s.lo, n.close), 0) - 1 >= 0.2 and n.close / nullif(greatest(s.hi, n.close), 0) - 1 <= -0.2 then 1 - s.state
    when n.close / nullif(least(s.lo, n.close), 0) - 1 >= 0.2 then 1 when n.close / nullif(greatest(s.hi, n.close), 0) - 1 <= -0.2 then 0 else s.state end, 0
   from s join n on n.symbol = s.symbol and n.rn = s.rn + 1),
 c as (select *, case when state is not null and state is distinct from lag(state) over (partition by symbol order by rn) then 1 else 0 end as began from s),
 d as (select *, sum(began) over (partition by symbol order by rn) as cycle from c)
 select symbol, open_time, round(rise, 6) as rise, round(fall, 6) as fall, cast(state as bigint) as is_bull, cast(began as bigint) as cycle_start, cast(cycle as bigint) as cycle_no,
 cast(case when state is not null and date_diff('day', min(open_time) over (partition by symbol, cycle), max(open_time) over (partition by symbol, cycle)) >= 20 then 1 else 0 end as bigint) as kept from d"""


def _one(c: str) -> str:
    return f"""g_{c} as (select symbol, median({c}) as med, quantile_cont({c}, 0.1) as a, quantile_cont({c}, 0.9) as z from b group by 1),
 h_{c} as (select b.symbol, median(abs({c} - med)) as mad, min(abs({c} - med)) filter (abs({c} - med) > 0) as least_dev from b join g_{c} using (symbol) group by 1)"""


def _bounds(c: str) -> str:
    near = f"abs(g_{c}.z - g_{c}.a) <= 1e-8 + 1e-5 * abs(g_{c}.z)"
    return f"coalesce(case when {near} then abs({c} - g_{c}.med) > 40 * h_{c}.least_dev else not ({c} between g_{c}.a - 5 * (g_{c}.z - g_{c}.a) and g_{c}.z + 5 * (g_{c}.z - g_{c}.a)) end, false)"


O02 = f"""with b as (select * from {{b}} as x), {_one("close")}, {_one("volume")}, f as (select symbol, open_time, abs(close - g_close.med) / nullif(1.4826 * h_close.mad, 0) as zc, abs(volume - g_volume.med) / nullif(1.4826 * h_volume.mad, 0) as zv,
  {_bounds("close")} as ic, {_bounds("volume")} as iv from b join g_close using (symbol) join h_close using (symbol) join g_volume using (symbol) join h_volume using (symbol))
 select symbol, open_time, round(zc, 6) as z_close, round(zv, 6) as z_volume, {_flags({"anomaly_z_close": "zc > 5", "anomaly_z_volume": "zv > 5", "anomaly_iqr_close": "ic", "anomaly_iqr_volume": "iv", "is_anomaly": "coalesce(zc > 5, false) or coalesce(zv > 5, false) or ic or iv"})} from f"""

O05 = f"""with x as (select *, lag({{'c': close, 't': open_time}}) over ({W}) as p, list(volume) over ({W} rows 23 preceding) as vs, case when high + low > 0 then 2 * (high - low) / (high + low) end as amp from {{b}}),
 y as (select *, list_median(list_filter(vs, lambda v: v <> 0)) as med, (select quantile_cont(amp, 0.95) from x as o where o.symbol = x.symbol) as base from x)
 select symbol, open_time, round(close / nullif(p.c, 0) - 1, 6) as pct, {
    _flags(
        {
            "anomaly_jump": "abs(close / nullif(p.c, 0) - 1) > 0.15", "anomaly_price": "least(open, high, low, close) <= 0", "anomaly_ohlc": "high < low or close not between low and high or open not between low and high",
            "anomaly_zero_volume": "volume = 0", "anomaly_negative_volume": "volume < 0", "anomaly_volume": "volume > 20 * med", "anomaly_flash": "amp > 3 * base",
            "anomaly_reversal": "amp > 2 * base and (coalesce(1 - close / nullif(high, 0) < 0.01, false) or coalesce(1 - low / nullif(close, 0) < 0.01, false))", "anomaly_gap": "epoch(open_time) - epoch(p.t) > 43200",
        }
    )
} from y"""  # fmt: skip

T01 = f"with x as (select symbol, open_time, {', '.join(f'{_last(n, "close")} as l{n}' for n in (5, 9, 10, 20, 50, 200))} from {{b}}) select symbol, open_time, {', '.join(f'round(list_avg(l{n}), 6) as sma_{n}' for n in (5, 9, 10, 20, 50, 200))} from x"
T03 = f"with x as (select symbol, open_time, {_last(15, 'close')} as l from {{b}}), y as (select *, list_transform(range(1, 15), lambda i: l[i + 1] - l[i]) as m from x), z as (select *, list_sum(list_filter(m, lambda v: v > 0)) as up, -list_sum(list_filter(m, lambda v: v < 0)) as down from y) select symbol, open_time, case when l is not null then round(100 * coalesce(up, 0) / nullif(coalesce(up, 0) + coalesce(down, 0), 0), 6) end as rsi_14 from z"
T05 = f"with x as (select symbol, open_time, close, {_last(20, 'close')} as l from {{b}}), y as (select *, list_avg(l) as m, list_stddev_samp(l) as sd from x) select symbol, open_time, round(m, 6) as bb_middle, round(m + 2 * sd, 6) as bb_upper, round(m - 2 * sd, 6) as bb_lower, round(4 * sd / nullif(m, 0), 6) as bb_width, round((close - m + 2 * sd) / nullif(4 * sd, 0), 6) as bb_percent from y"
T06 = f"with x as (select symbol, open_time, close, {_last(14, 'low')} as lo, {_last(14, 'high')} as hi from {{b}}), y as (select *, 100 * (close - list_min(lo)) / nullif(list_max(hi) - list_min(lo), 0) as raw from x), k as (select *, {_last(3, 'raw')} as l3 from y), d as (select *, case when len(list_filter(l3, lambda v: v is not null)) = 3 then list_avg(l3) end as k from k), e as (select *, {_last(3, 'k')} as k3 from d) select symbol, open_time, round(k, 6) as stoch_k, case when len(list_filter(k3, lambda v: v is not null)) = 3 then round(list_avg(k3), 6) end as stoch_d from e"
W01 = "with x as (select *, row_number() over (partition by symbol order by open_time) as rn from {b}) select a.symbol, a.open_time, " + ", ".join(f"round(l{k}.{c}, 6) as {c}_lag_{k}" for c in ("close", "volume") for k in (1, 3, 5, 7, 14)) + " from x a " + " ".join(f"left join x l{k} on l{k}.symbol = a.symbol and l{k}.rn = a.rn - {k}" for k in (1, 3, 5, 7, 14))


def _sum(n: int, x: str) -> str:
    return f"case when len(list_filter(l{n}, lambda e: ({x}) is not null)) = {n} then list_avg(list_transform(l{n}, lambda e: {x})) end"


def _w02(n: int) -> str:
    names = {"mean": "list_avg", "std": "list_stddev_samp", "min": "list_min", "max": "list_max", "sum": "list_sum", "var": "list_var_samp", "median": "list_median"}
    plain = [f"round({fn}(l{n}), 6) as close_rolling_{n}_{name}" for name, fn in names.items()]
    quartiles = [f"round(list_aggregate(l{n}, 'quantile_cont', {q}), 6) as close_rolling_{n}_q{int(q * 100)}" for q in (0.25, 0.75)]
    shape = [f"case when len(l{n}) >= {k} and list_min(l{n}) < list_max(l{n}) then round(list_{fn}(l{n}), 6) end as close_rolling_{n}_{name}" for name, fn, k in (("skew", "skewness", 3), ("kurt", "kurtosis", 4))]
    return ", ".join(plain + quartiles + shape)


W02 = f"with x as (select symbol, open_time, list(close) over ({W} rows 4 preceding) as l5, list(close) over ({W} rows 13 preceding) as l14 from {{b}}) select symbol, open_time, {_w02(5)}, {_w02(14)} from x"

def volatility_twin(ns: tuple[int, ...]) -> str:
    return f"""with x as (select *, lag(close) over ({W}) as pc from {{b}}), y as (select symbol, open_time, ln(close / nullif(pc, 0)) as lr, ln(high / nullif(low, 0)) as hl, ln(close / nullif(open, 0)) as oc, ln(open / nullif(pc, 0)) as ov,
  ln(high / nullif(close, 0)) * ln(high / nullif(open, 0)) + ln(low / nullif(close, 0)) * ln(low / nullif(open, 0)) as rs from x),
 z as (select symbol, open_time, {', '.join(f"{_last(n, '{r: lr, h: hl, c: oc, v: ov, s: rs}')} as l{n}" for n in ns)} from y),
 k as (select *, {', '.join(f"case when len(list_filter(l{n}, lambda e: e.r is not null)) = {n} then list_stddev_samp(list_transform(l{n}, lambda e: e.r)) * sqrt(365) end as hist_vol_{n}, sqrt(list_avg(list_transform(l{n}, lambda e: e.h * e.h)) / (4 * ln(2)) * 365) as parkinson_{n}, sqrt(greatest(list_avg(list_transform(l{n}, lambda e: 0.5 * e.h * e.h - (2 * ln(2) - 1) * e.c * e.c)), 0) * 365) as garman_klass_{n}, case when len(list_filter(l{n}, lambda e: e.v is not null)) = {n} then sqrt(365 * (list_var_samp(list_transform(l{n}, lambda e: e.v)) + 0.34 * list_var_samp(list_transform(l{n}, lambda e: e.c)) + 0.66 * list_avg(list_transform(l{n}, lambda e: e.s)))) end as yang_zhang_{n}" for n in ns)} from z),
 m as (select *, {_last(20, "hist_vol_14")} as v20, {_last(14, "hist_vol_14")} as v14 from k), q as (select *, len(list_filter(v20, lambda v: v is not null)) = 20 as full20, len(list_filter(v14, lambda v: v is not null)) = 14 as full14 from m)
 select symbol, open_time, {', '.join(f'round({c}_{n}, 6) as {c}_{n}' for n in ns for c in ('hist_vol', 'parkinson', 'garman_klass', 'yang_zhang'))}, case when full14 then round(list_stddev_samp(v14), 6) end as vol_of_vol, round(hist_vol_14 / nullif(hist_vol_30, 0), 6) as rel_vol,
 cast(coalesce(full20 and hist_vol_14 > list_avg(v20) + 2 * list_stddev_samp(v20), false) as bigint) as vol_breakout from q"""


V01 = volatility_twin((14, 30))

_RN = "with x as (select *, row_number() over (partition by symbol order by open_time) as rn from {b})"


def _w08() -> str:
    steps = {p: f"(select symbol, open_time, close, {_last(p + 1, 'close')} as l from {{b}})" for p in (1, 3, 7)}
    parts, outs = [], []
    for p in steps:
        n = max(2, 5 * p)
        parts.append(f"r{p} as (select symbol, open_time, close, l[1] as c, close / nullif(l[1], 0) - 1 as r from {steps[p]})")
        parts.append(f"z{p} as (select *, list_filter(list(r) over ({W} rows {n - 1} preceding), lambda v: v is not null) as rs from r{p})")
        z = f"case when len(z{p}.rs) >= {n // 2} then (z{p}.r - list_avg(z{p}.rs)) / nullif(list_stddev_samp(z{p}.rs), 0) end"
        outs.append(f"round(z{p}.r, 6) as return_{p}p, round(ln(z{p}.close / nullif(z{p}.c, 0)), 6) as log_return_{p}p, round(z{p}.close - z{p}.c, 6) as abs_change_{p}p, cast(sign(z{p}.close - z{p}.c) as bigint) as direction_{p}p, round({z}, 6) as z_score_return_{p}p")
    return f"with {', '.join(parts)} select z1.symbol, z1.open_time, {', '.join(outs)} from z1 join z3 using (symbol, open_time) join z7 using (symbol, open_time)"


W08 = _w08()
W10 = f"""{_RN}, k as (select symbol, rn, close / nullif(lag(close) over ({W}), 0) - 1 as r from x), f as (select a.symbol, a.rn, count(*) as n, max(n.high) as hi, min(n.low) as lo, stddev_samp(k.r) as sd from x a join x n on n.symbol = a.symbol and n.rn between a.rn + 1 and a.rn + 3 join k on k.symbol = n.symbol and k.rn = n.rn group by 1, 2)
 select a.symbol, a.open_time, round(c3.close / nullif(a.close, 0) - 1, 6) as target_return, round(ln(c3.close / nullif(a.close, 0)), 6) as target_log_return, case when c3.close is not null then cast(c3.close > a.close as bigint) end as target_direction, round(c3.close, 6) as target_price,
 round(case when f.n = 3 then (f.hi - f.lo) / nullif(a.close, 0) end, 6) as target_range, round(c1.close, 6) as target_close_1, round(c5.close, 6) as target_close_5, round(c10.close, 6) as target_close_10, round(a.close / nullif(p.close, 0) - 1, 6) as step_return, round(case when f.n = 3 then f.sd end, 6) as target_volatility
 from x a left join f on f.symbol = a.symbol and f.rn = a.rn {" ".join(f"left join x c{k} on c{k}.symbol = a.symbol and c{k}.rn = a.rn + {k}" for k in (1, 3, 5, 10))} left join x p on p.symbol = a.symbol and p.rn = a.rn - 1"""
W12 = f"""{_RN}, l as (select symbol, open_time, rn, {_last(5, "close")} as l5, {_last(20, "close")} as l20 from x), m as (select *, list_avg(l5) as f, list_avg(l20) as s from l), c as (select a.*, p.f - p.s as before, q.f as f3, q.s as s3 from m a left join m p on p.symbol = a.symbol and p.rn = a.rn - 1 left join m q on q.symbol = a.symbol and q.rn = a.rn - 3),
 g as (select *, f > s and before <= 0 as golden, f < s and before >= 0 as death from c)
 select symbol, open_time, round(f, 6) as fast, round(s, 6) as slow, round(f - s, 6) as diff, round(100 * (f / nullif(s, 0) - 1), 6) as rel_diff, cast(sign(f - s) as bigint) as state, cast(coalesce(golden, false) as bigint) as golden_cross, cast(coalesce(death, false) as bigint) as death_cross, round(f - f3 - s + s3, 6) as slope_diff,
 rn - coalesce((select max(h.rn) from g h where h.symbol = g.symbol and h.rn <= g.rn and (h.golden or h.death)), 1) as bars_since_cross from g"""
W14 = f"""with x as (select *, high - low as r, greatest(open, close) as top, least(open, close) as bottom, list(volume) over ({W} rows 23 preceding) as vs from {{b}})
 select symbol, open_time, round(r / nullif(low, 0), 6) as range_pct, round(volume * low / nullif(r, 0), 6) as volume_per_range, cast(volume = 0 as bigint) as zero_volume, cast(r = 0 as bigint) as flat_candle, round(100 * (close / nullif(open, 0) - 1), 6) as price_change_pct, round((top - bottom) / nullif(r, 0), 6) as body_pct,
 round((high - top) / nullif(r, 0), 6) as upper_shadow_pct, round((bottom - low) / nullif(r, 0), 6) as lower_shadow_pct, cast(coalesce((top - bottom) / nullif(open, 0) < 0.0005, false) as bigint) as is_doji, round(list_avg(vs), 6) as volume_ma_24, cast(volume > 3 * list_avg(vs) as bigint) as volume_spike from x"""
G05 = """with x as (select *, row_number() over (partition by symbol order by open_time) as rn from {b}) select a.symbol, a.open_time, round(a.close - p.close, 6) as diff, round(ln(a.close), 6) as log_close, round(a.close / nullif(p.close, 0) - 1, 6) as pct, round(a.close - s.close, 6) as seasonal, round(a.high - a.low, 6) as high_low_range, round(a.close - a.open, 6) as open_close,
 round(a.close - 2 * p.close + q.close, 6) as diff2, round(ln(a.close / nullif(p.close, 0)), 6) as log_diff, round(a.close - s.close - p.close + t.close, 6) as combo from x a left join x p on p.symbol = a.symbol and p.rn = a.rn - 1 left join x q on q.symbol = a.symbol and q.rn = a.rn - 2 left join x s on s.symbol = a.symbol and s.rn = a.rn - 6 left join x t on t.symbol = a.symbol and t.rn = a.rn - 7"""
R01 = """with x as (select *, row_number() over (partition by symbol order by open_time) as rn from {b}), n as (select a.symbol, a.rn, count(*) as k, max(o.high) as hi, min(o.low) as lo from x a join x o on o.symbol = a.symbol and o.rn <> a.rn and abs(o.rn - a.rn) <= 5 group by 1, 2)
 select x.symbol, x.open_time, cast(high > hi as bigint) as swing_high, cast(low < lo as bigint) as swing_low, round((high - hi) / nullif(high, 0), 6) as high_strength from x join n on n.symbol = x.symbol and n.rn = x.rn where k = 10 and (high > hi or low < lo)"""
T09 = f"""with x as (select *, (high + low + close) / 3 as tp, case when high > low then ((close - low) - (high - close)) / (high - low) else 0 end as clv, case when close > lag(close) over ({W}) then volume when close < lag(close) over ({W}) then -volume else 0 end as sv, cast(open_time as date) as d from {{b}}),
 s as (select a.symbol, a.open_time, sum(o.sv) as obv, sum(o.clv * o.volume) as ad, sum(o.tp * o.volume) filter (o.d = a.d) / nullif(sum(o.volume) filter (o.d = a.d), 0) as session from x a join x o on o.symbol = a.symbol and o.open_time <= a.open_time group by 1, 2),
 l as (select symbol, open_time, sv, {", ".join(f"{_last(n, '{t: tp, v: volume}')} as l{n}" for n in (14, 30))} from x)
 select l.symbol, l.open_time, round(obv, 6) as obv, round(sv, 6) as volume_delta, round(ad, 6) as accumulation, {", ".join(f"round(list_sum(list_transform(l{n}, lambda e: e.t * e.v)) / nullif(list_sum(list_transform(l{n}, lambda e: e.v)), 0), 6) as vwap_{n}" for n in (14, 30))}, round(session, 6) as vwap_session from l join s using (symbol, open_time)"""
T16 = f"""with x as (select *, row_number() over ({W}) as rn, {", ".join(f"{_last(n, '{h: high, l: low}')} as l{n}" for n in (9, 26, 52))} from {{b}}), m as (select symbol, open_time, rn, close, {", ".join(f"(list_max(list_transform(l{n}, lambda e: e.h)) + list_min(list_transform(l{n}, lambda e: e.l))) / 2 as m{n}" for n in (9, 26, 52))} from x)
 select a.symbol, a.open_time, round(a.m9, 6) as tenkan, round(a.m26, 6) as kijun, round(f.close, 6) as chikou_future, round((p.m9 + p.m26) / 2, 6) as senkou_a, round(p.m52, 6) as senkou_b from m a left join m f on f.symbol = a.symbol and f.rn = a.rn + 26 left join m p on p.symbol = a.symbol and p.rn = a.rn - 26"""

_V9 = {5: "v5", 10: "v10", 20: "v20"}
W09 = f"""with x as (select *, lag(volume) over ({W}) as pv, cast(open_time as date) as d, {", ".join(f"list(volume) over ({W} rows {n - 1} preceding) as v{n}" for n in _V9)} from {{b}}), y as (select *, {", ".join(f"lag(list_avg(v{n})) over ({W}) as p{n}" for n in _V9)}, (select sum(o.volume) from x o where o.symbol = x.symbol and cast(o.open_time as date) = x.d and o.open_time <= x.open_time) as day_sum from x)
 select symbol, open_time, {", ".join(f"round(list_avg(v{n}), 6) as volume_ma_{n}" for n in _V9)}, round(volume - pv, 6) as volume_change, round((volume - pv) / nullif(pv, 0), 6) as volume_pct_change, round(day_sum, 6) as volume_day_sum, {", ".join(f"round(volume / nullif(list_avg(v{n}), 0), 6) as volume_rel_{n}" for n in _V9)},
 {", ".join(f"case when len(v{n}) = {n} then round((volume - list_avg(v{n})) / nullif(list_stddev_samp(v{n}), 0), 6) end as volume_z_{n}" for n in _V9)}, {", ".join(f"round(list_avg(v{n}) / nullif(p{n}, 0) - 1, 6) as volume_ma_change_{n}" for n in _V9)}, cast(coalesce(volume > 2 * list_avg(v20), false) as bigint) as volume_anomaly from y"""
T07 = f"""with x as (select *, lag({{'c': close, 'h': high, 'l': low}}) over ({W}) as p from {{b}}), y as (select *, case when p is null then high - low else greatest(high, p.c) - least(low, p.c) end as tr, high - p.h as up, p.l - low as down from x),
 z as (select *, {_last(14, "tr")} as trs, {_last(14, "{u: case when up is not null then case when up > down and up > 0 then up else 0 end end, d: case when up is not null then case when down > up and down > 0 then down else 0 end end}")} as ms from y),
 k as (select *, list_avg(trs) as atr, list_transform(ms, lambda e: e.u) as us, list_transform(ms, lambda e: e.d) as ds from z), q as (select *, case when len(list_filter(us, lambda v: v is not null)) = 14 then 100 * list_avg(us) / nullif(atr, 0) end as pdi, case when len(list_filter(ds, lambda v: v is not null)) = 14 then 100 * list_avg(ds) / nullif(atr, 0) end as mdi from k),
 r as (select *, {_last(14, "100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)")} as dxs from q) select symbol, open_time, round(tr, 6) as tr, round(atr, 6) as atr, round(pdi, 6) as plus_di, round(mdi, 6) as minus_di, case when len(list_filter(dxs, lambda v: v is not null)) = 14 then round(list_avg(dxs), 6) end as adx from r"""
T10 = f"""with x as (select *, (high + low + close) / 3 as tp from {{b}}), y as (select *, {", ".join(f"lag(close, {n}) over ({W}) as c{n}" for n in (5, 10, 20))}, {_last(15, "high")} as hs, {_last(15, "low")} as ls, {_last(20, "tp")} as tps from x)
 select symbol, open_time, {", ".join(f"round(100 * (close - c{n}) / nullif(c{n}, 0), 6) as roc_{n}" for n in (5, 10, 20))}, round(100.0 * (list_position(hs, list_max(hs)) - 1) / 14, 6) as aroon_up, round(100.0 * (list_position(ls, list_min(ls)) - 1) / 14, 6) as aroon_down,
 round((tp - list_avg(tps)) / nullif(0.015 * list_avg(list_transform(tps, lambda v: abs(v - list_avg(tps)))), 0), 6) as cci_20 from y"""
_R11 = {"high_low": "high / nullif(low, 0)", "close_open": "close / nullif(open, 0)", "volume_close": "volume / nullif(close, 0)"}
W11 = f"""with x as (select symbol, open_time, {", ".join(f"{r} as {k}" for k, r in _R11.items())} from {{b}}), s as (select symbol, {", ".join(f"quantile_cont({k}, [0.01, 0.5, 0.99]) as q_{k}" for k in _R11)} from x group by 1)
 select symbol, open_time, {", ".join(f"round(case when coalesce({k}, q_{k}[2]) < q_{k}[1] then q_{k}[1] when coalesce({k}, q_{k}[2]) > q_{k}[3] then q_{k}[3] else coalesce({k}, q_{k}[2]) end, 6) as ratio_{k}" for k in _R11)} from x join s using (symbol)"""
M03 = """with s as (select symbol, avg(close) as mu, stddev_pop(close) as sd, min(close) as mn, max(close) as mx, quantile_cont(close, [0.25, 0.5, 0.75]) as q, min(volume) as vn, max(volume) as vx from {b} group by 1)
 select symbol, open_time, round((close - mu) / nullif(sd, 0), 6) as close_z, round(0.01 + 0.99 * (close - mn) / nullif(mx - mn, 0), 6) as close_minmax, round((close - q[2]) / nullif(q[3] - q[1], 0), 6) as close_robust, round((volume - vn) / nullif(vx - vn, 0), 6) as volume_minmax, case when mx > mn then round(close, 6) end as close_back from {b} join s using (symbol)"""

#: Name of the query -> its twin over bars named b.
TWINS = {
    "k01_candle_patterns": K01, "c01_custom": C01, "y04_market_phase": Y04, "y05_bull_bear": Y05, "o02_robust_outliers": O02, "o05_domain_rules": O05, "t01_sma": T01, "t03_rsi_simple": T03,
    "t05_bollinger": T05, "t06_stochastic": T06, "w01_lagged": W01, "w02_rolling": W02, "v01_volatility": V01,
    "w08_returns": W08, "w10_targets": W10, "w12_crossover": W12, "w14_microstructure": W14, "g05_stationary": G05, "r01_swings": R01, "t09_volume_indicators": T09, "t16_ichimoku": T16, "w09_volumes": W09, "t07_atr_adx": T07, "t10_momentum": T10, "w11_ratios": W11, "m03_normalized": M03,
}


def twin(name: str, bars: str) -> str:
    """The twin of a query over bars given as SQL."""
    return TWINS[name].replace("{b}", f"({bars})")
