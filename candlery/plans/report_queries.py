"""Reports whose SQL text both engines read: levels, cycles, fills, forecasts, summaries.

{b} stands for the bars (symbol, open_time, open, high, low, close, volume), other names in braces for further tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from candlery.functions.sqlwin import WC, WP, W, duck, frame, lag, lead, log, ratio, spark_text
from candlery.operators import news, seasonality
from candlery.operators.features import CATALOG, LOGRET, RET
from candlery.plans.candle_queries import DAILY_SQL, FOUR_HOURS_SQL, daily, four_hours
from candlery.plans.relation_queries import N01_SQL
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Report:
    """One SQL text over named inputs: for each its DataFrame (Spark) and its SQL (DuckDB)."""

    text: str
    inputs: dict[str, tuple[Query, str]]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.sql(spark_text(self.text), **{k: f(spark, folder) for k, (f, _) in self.inputs.items() if f"{{{k}}}" in self.text})

    def sql(self) -> str:
        used = {k: sql for k, (_, sql) in self.inputs.items() if f"{{{k}}}" in self.text}
        heads = ", ".join(f"{k}_in as ({sql})" for k, sql in used.items())
        body = duck(self.text.format(**{k: f"{k}_in" for k in used}))
        return f"with {heads}, {body[5:]}" if body.lstrip().lower().startswith("with ") else f"with {heads} {body}"


def _raw(name: str) -> tuple[Query, str]:
    return (lambda s, d: table(s, d, name), f"select * from {name}")


def _plan(name: str, base: Query, sql: str) -> tuple[Query, str]:
    return (lambda s, d: CATALOG[name].apply(base(s, d)), CATALOG[name].sql(sql))


BARS = {"b": (four_hours, FOUR_HOURS_SQL), "d": (daily, DAILY_SQL), "vol": _plan("v01_volatility", four_hours, FOUR_HOURS_SQL), "phase": _plan("y04_market_phase", daily, DAILY_SQL),
        "dvol": _plan("v01_volatility", daily, DAILY_SQL), "swings": _plan("r01_swings", four_hours, FOUR_HOURS_SQL), "rsi": _plan("t03_rsi_simple", four_hours, FOUR_HOURS_SQL)}
TABLES = {n: _raw(n) for n in ("events", "orders", "customer", "lineitem", "documents", "btc_klines", "nation")}
MOOD = {"mood": (lambda s, d: news.sentiment(table(s, d, "documents")), N01_SQL)}
BACK = f"({W} rows between current row and unbounded following)"

TEXTS = {
    # scans, filters, sets
    "s03_scan_range": "select symbol, open_time, open, close from {b} where symbol = 'click' and open_time between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 00:00:00' order by open_time desc limit 20",
    "f03_first_of_time": "with r as (select *, row_number() over (partition by o_orderdate order by o_orderkey) as rn from {orders}) select o_orderdate, o_orderkey, o_totalprice from r where rn = 1",
    "u03_distinct": "select distinct symbol from {b}",
    "u04_adjacent_sets": "with w as (select distinct symbol, cast(floor((day(open_time) - 1) / 7) as bigint) as week_no from {b}) select a.symbol, a.week_no from w a join w n on a.symbol = n.symbol and n.week_no = a.week_no + 1",
    "j14_semi_anti": "select 'with orders' as side, count(*) as n from {customer} where c_custkey in (select o_custkey from {orders}) union all select 'without', count(*) from {customer} where not exists (select 1 from {orders} where o_custkey = c_custkey)",
    "j12_join_nation": "select n_name, count(*) as customers, round(sum(c_acctbal), 2) as balance from {customer} join {nation} on c_nationkey = n_nationkey group by n_name",
    # fills and scaling
    "m05_minmax_inverse": f"with s as (select *, min(close) over {WP} as mn, max(close) over {WP} as mx from {{b}}), t as (select *, {ratio('close - mn', 'mx - mn')} as scaled from s) select symbol, open_time, round(scaled, 6) as scaled, round(scaled * (mx - mn) + mn, 6) as restored from t",
    "m07_skewed_logs": "with s as (select symbol, avg(volume) as mu, stddev_pop(volume) as sd from {b} group by symbol), m as (select b.symbol, avg(power((b.volume - s.mu) / nullif(s.sd, 0), 3)) as skew from {b} b join s on b.symbol = s.symbol group by b.symbol) select b.symbol, b.open_time, round(case when abs(m.skew) > 0.3 then ln(1 + b.volume) else b.volume end, 6) as volume_t from {b} b join m on b.symbol = m.symbol",
    # aggregates
    "a05_volatility_by_phase": "select p.symbol, p.phase, count(v.hist_vol_14) as n, round(avg(v.hist_vol_14), 6) as mean_v, round(percentile(v.hist_vol_14, 0.25), 6) as p25, round(percentile(v.hist_vol_14, 0.75), 6) as p75 from {phase} p join {dvol} v on p.symbol = v.symbol and p.open_time = v.open_time where p.phase is not null group by p.symbol, p.phase having count(v.hist_vol_14) >= 10",
    "a07_volatility_summary": f"""with k as (select symbol, open_time, hist_vol_14 as v, row_number() over (partition by symbol order by open_time desc) as rk, avg(hist_vol_14) over {WP} as mu from {{vol}} where hist_vol_14 is not null), c as (select symbol, max(case when rk = 1 then v end) as now_v, max(case when rk = 8 then v end) as then_v from k group by symbol)
 select k.symbol, round(max(c.now_v), 6) as now_v, round(avg(v), 6) as mean_v, round(percentile(v, 0.9), 6) as p90, round(percentile(v, 0.1), 6) as p10, cast(sum(case when v > mu then 1 else 0 end) as bigint) as above_mean, round(max(c.now_v) / max(c.then_v) - 1, 6) as trend,
 round(cast(100 as double) * (sum(case when v < c.now_v then 1 else 0 end) + sum(case when v <= c.now_v then 1 else 0 end)) / 2 / count(*), 6) as percentile_now from k join c on k.symbol = c.symbol group by k.symbol""",
    "j08_january_effect": "with r as (select symbol, year(open_time) as y, month(open_time) as m, max_by(close, open_time) / nullif(min_by(close, open_time), 0) - 1 as ret from {d} group by symbol, year(open_time), month(open_time)), j as (select symbol, y, ret as january from r where m = 1), o as (select symbol, y, avg(ret) as others from r where m <> 1 group by symbol, y) select j.symbol, cast(j.y as bigint) as year_no, round(january, 6) as january, round(others, 6) as others, round(january - others, 6) as effect from j join o on j.symbol = o.symbol and j.y = o.y",
    # trend, levels, patterns
    "r10_double_tops": f"""with x as (select b.symbol, b.open_time, b.high, b.low, coalesce(w.swing_high, 0) as s from {{b}} b left join {{swings}} w on w.symbol = b.symbol and w.open_time = b.open_time), g as (select *, sum(s) over {WC} as top_no from x),
 t as (select symbol, top_no, min(case when s = 1 then open_time end) as open_time, max(case when s = 1 then high end) as first_top, min(case when s = 0 then low end) as neckline from g where top_no > 0 group by symbol, top_no),
 n as (select *, lead(first_top) over (partition by symbol order by top_no) as second_top, lead(open_time) over (partition by symbol order by top_no) as at2 from t)
 select symbol, open_time, at2, round(first_top, 6) as first_top, round(second_top, 6) as second_top, round(neckline, 6) as neckline from n where abs(second_top / first_top - 1) <= 0.1""",
    # cycles
    "y07_quarter_cycle_roi": "with q as (select symbol, open_time, close, first_value(close) over (partition by symbol, date_trunc('quarter', open_time) order by open_time) as first_close, row_number() over (partition by symbol, date_trunc('quarter', open_time) order by open_time) as day_no from {d}), r as (select symbol, day_no, close / nullif(first_close, 0) - 1 as roi from q) select symbol, cast(day_no as bigint) as day_no, count(*) as n, round(avg(roi), 6) as mean_roi, round(stddev_samp(roi), 6) as sd_roi from r group by symbol, day_no",
    "y08_similar_stretches": """with k as (select symbol, open_time, close, row_number() over (partition by symbol order by open_time desc) as rk, avg(close) over (partition by symbol) as mu, stddev_pop(close) over (partition by symbol) as sd from {d}), z as (select symbol, rk, (close - mu) / nullif(sd, 0) as z from k), now_z as (select symbol, rk, z from z where rk <= 20),
 offs as (select distinct symbol, rk - 1 as off from z where rk > 20), m as (select o.symbol, o.off, sqrt(sum(power(n.z - p.z, 2))) as dist, count(*) as n from offs o join now_z n on n.symbol = o.symbol join z p on p.symbol = o.symbol and p.rk = n.rk + o.off group by o.symbol, o.off)
 select symbol, cast(off as bigint) as bars_back, round(dist, 6) as distance, round(1 / (1 + dist), 6) as similarity from m where n = 20""",
    "y09_turning_points": f"""with k as (select symbol, open_time, close, min(low) over {frame(30, 1)} as low30, max(high) over {frame(30, 1)} as high30, avg(volume) over {frame(30, 1)} as v30, volume, count(close) over {frame(30, 1)} as n from {{b}}),
 s as (select *, case when close <= low30 * 1.2 then 0.5 else 0 end + case when volume > v30 then 0.3 else 0 end as bottom_score, case when close >= high30 * 0.8 then 0.5 else 0 end + case when volume > v30 then 0.3 else 0 end as top_score from k where n = 30)
 select symbol, open_time, round(cast(bottom_score as double), 6) as bottom_score, round(cast(top_score as double), 6) as top_score from s where bottom_score >= 0.5 or top_score >= 0.5""",
    # volatility, models, evaluation
    "v10_breakout_days": "select symbol, cast(sum(vol_breakout) as bigint) as breakouts, count(*) as bars from {vol} group by symbol",
    "v14_ml_features": f"with x as (select symbol, open_time, hist_vol_14 as v, parkinson_14 as p from {{vol}}), y as (select *, v - {lag('v')} as change, {lag('v')} as before, avg(v) over {frame(30)} as m30, stddev_samp(v) over {frame(30)} as s30, count(v) over {frame(30)} as n30 from x) select symbol, open_time, round(change, 6) as vol_change, round(before, 6) as vol_lag, round({log('v')}, 6) as log_vol, round(case when n30 = 30 then {ratio('v - m30', 's30')} end, 6) as vol_z30, round({ratio('p', 'v')}, 6) as hl_ratio from y",
    "l06_chrono_split": "with p as (select symbol, open_time, percent_rank() over (partition by symbol order by open_time) as place from {b}) select symbol, case when place < 0.8 then 'train' else 'test' end as part, count(*) as n, min(open_time) as first_at, max(open_time) as last_at from p group by symbol, case when place < 0.8 then 'train' else 'test' end",
    "w07_one_hot": "select symbol, open_time, " + ", ".join(f"case when phase = {k} then 1 else 0 end as phase_{n}" for k, n in ((1, "accumulation"), (2, "uptrend"), (3, "distribution"), (4, "downtrend"))) + " from {phase}",
    "o08_cycle_anomalies": f"with c as (select symbol, open_time, {RET} as r1, close / nullif({lag('close', 7)}, 0) - 1 as r7 from {{d}}), z as (select *, (r1 - avg(r1) over {frame(365)}) / nullif(stddev_samp(r1) over {frame(365)}, 0) as z1, (r7 - avg(r7) over {frame(365)}) / nullif(stddev_samp(r7) over {frame(365)}, 0) as z7, count(r7) over {frame(365)} as n from c) select symbol, open_time, round(z1, 5) as z1, round(z7, 5) as z7 from z where n >= 30 and (abs(z1) > 3 or abs(z7) > 3)",
    "q01_daily_shipments": "select l_shipdate, l_returnflag, count(*) as n, round(sum(l_quantity), 2) as quantity, round(avg(l_discount), 6) as discount from {lineitem} group by l_shipdate, l_returnflag",
}


def _reports() -> dict[str, Report]:
    return {name: Report(text, BARS | TABLES | MOOD) for name, text in TEXTS.items()}


def y08_similar_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Every past stretch by lists of twenty bars; its twin joins bars by their distance."""
    return seasonality.similar_stretches(daily(spark, folder))


def queries() -> dict[str, Query]:
    return {name: report.run for name, report in _reports().items()} | {"y08_similar_stretches": y08_similar_stretches}


def oracle_sql() -> dict[str, str]:
    return {name: report.sql() for name, report in _reports().items()}
