"""Queries of joins, aggregates, correlation, text, registry and model operators, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlery.operators import correlation, joins, learning, models, news, pipeline, registry, seasonality
from candlery.operators.features import CATALOG, volatility
from candlery.plans.candle_queries import DAILY_SQL, FOUR_HOURS_SQL, daily, four_hours
from candlery.plans.twins import TWINS, twin
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# An event calendar inside the range of the daily bars.
CALENDAR = [("1996-03-05", "first"), ("1997-11-20", "second"), ("1999-06-15", "third"), ("2000-12-01", "fourth")]
CALENDAR_SQL = ", ".join(f"(timestamp '{d} 00:00:00', '{n}')" for d, n in CALENDAR)


def calendar(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(CALENDAR, "d string, event_name string")
    return rows.select(F.to_timestamp_ntz(F.col("d"), F.lit("yyyy-MM-dd")).alias("event_at"), "event_name")


def _days_sql(a: str, b: str) -> str:
    return f"date_diff('day', cast({a} as date), cast({b} as date))"


# --- joins


def j05_asof_events(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with the event before and after: days since and to, phase between them."""
    bars = daily(spark, folder).select("symbol", "open_time", "close")
    symbols = bars.select("symbol").distinct()
    found = joins.asof(bars, symbols.crossJoin(F.broadcast(calendar(spark))), ["symbol"], "open_time", "event_at", ["event_name"])
    since, to = F.datediff("open_time", "prev_at"), F.datediff("next_at", "open_time")
    return found.select("symbol", "open_time", "prev_event_name", "next_event_name", since.cast("long").alias("days_since"), to.cast("long").alias("days_to"), F.round(since / (since + to), 6).alias("phase"))


J05_SQL = f"""with b as ({DAILY_SQL}), e as (select * from (values {CALENDAR_SQL}) v(event_at, event_name)),
 x as (select b.symbol, b.open_time, p.event_at as pa, p.event_name as pn from b asof left join e p on b.open_time >= p.event_at),
 y as (select b.symbol, b.open_time, n.event_at as na, n.event_name as nn from b asof left join e n on b.open_time < n.event_at)
 select x.symbol, x.open_time, pn as prev_event_name, nn as next_event_name, {_days_sql("pa", "x.open_time")} as days_since, {_days_sql("x.open_time", "na")} as days_to,
 round({_days_sql("pa", "x.open_time")} / ({_days_sql("pa", "x.open_time")} + {_days_sql("x.open_time", "na")}), 6) as phase from x join y on x.symbol = y.symbol and x.open_time = y.open_time"""


def y01_event_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Cycles between events: number, log distance, sine and cosine of the phase, change since the cycle's first bar."""
    base = j05_asof_events(spark, folder).join(daily(spark, folder).select("symbol", "open_time", "close"), ["symbol", "open_time"])
    cycle = Window.partitionBy("symbol", "prev_event_name").orderBy("open_time")
    change = F.try_divide(F.col("close"), F.first("close").over(cycle.rowsBetween(Window.unboundedPreceding, 0))) - 1
    rows = base.where("prev_event_name is not null")
    wave = 2 * F.pi() * F.col("phase")
    return rows.select("symbol", "open_time", F.col("prev_event_name").alias("cycle_event"), F.round(F.log1p("days_since"), 6).alias("log_days"), F.round(F.sin(wave), 5).alias("phase_sin"), F.round(F.cos(wave), 5).alias("phase_cos"), F.round(change, 6).alias("cycle_change"))


Y01_SQL = f"""with a as ({J05_SQL}), b as ({DAILY_SQL}) select a.symbol, a.open_time, prev_event_name as cycle_event, round(ln(1 + days_since), 6) as log_days,
 round(sin(2 * pi() * phase), 5) as phase_sin, round(cos(2 * pi() * phase), 5) as phase_cos,
 round(b.close / first_value(b.close) over (partition by a.symbol, prev_event_name order by a.open_time) - 1, 6) as cycle_change
 from a join b on a.symbol = b.symbol and a.open_time = b.open_time where prev_event_name is not null"""


def j06_near_events(spark: SparkSession, folder: str) -> DataFrame:
    bars = daily(spark, folder).select("symbol", "open_time", "close")
    found = joins.near_events(bars, calendar(spark), "open_time", "event_at", "event_name", 30, 30)
    return found.withColumn("days_from_event", F.col("days_from_event").cast("long")).withColumn("close", F.round("close", 4))


J06_SQL = f"""with b as ({DAILY_SQL}), e as (select * from (values {CALENDAR_SQL}) v(event_at, event_name)),
 m as (select b.symbol, b.open_time, b.close, max(e.event_at) as ea from b left join e on b.open_time >= e.event_at - interval 30 day and b.open_time < e.event_at + interval 30 day group by all)
 select m.symbol, m.open_time, round(m.close, 4) as close, e.event_name as near_label, {_days_sql("ea", "m.open_time")} as days_from_event from m left join e on e.event_at = m.ea"""


def j01_aligned(spark: SparkSession, folder: str) -> DataFrame:
    grid = joins.aligned(four_hours(spark, folder), 14_400)
    return grid.withColumn("close", F.round("close", 6))


J01_SQL = f"""with b as ({FOUR_HOURS_SQL}), s as (select symbol, min(open_time) lo, max(open_time) hi from b group by 1), c as (select max(lo) f, min(hi) t from s),
 g as (select symbol, unnest(generate_series(f, t, interval 4 hour)) as open_time from s, c),
 a as (select coalesce(g.symbol, b.symbol) as symbol, coalesce(g.open_time, b.open_time) as open_time, b.close, g.symbol is not null as on_grid, epoch(coalesce(g.open_time, b.open_time)) as s
   from g full join b on g.symbol = b.symbol and g.open_time = b.open_time),
 k as (select *, case when close is not null then s end as known from a),
 f as (select *, last_value(close ignore nulls) over w v0, first_value(close ignore nulls) over x v1, last_value(known ignore nulls) over w t0, first_value(known ignore nulls) over x t1 from k
   window w as (partition by symbol order by s rows between unbounded preceding and current row), x as (partition by symbol order by s rows between current row and unbounded following))
 select symbol, open_time, round(coalesce(case when t1 > t0 then v0 + (v1 - v0) * (s - t0) / (t1 - t0) end, v0, v1), 6) as close from f where on_grid"""


def j02_wide_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Closes of all symbols side by side: an outer join on time as one pivot. The symbols are read first."""
    wide = four_hours(spark, folder).groupBy("open_time").pivot("symbol").agg(F.round(F.max("close"), 4))
    return wide.toDF("open_time", *[f"close_{n}" for n in wide.columns[1:]])


J02_SQL = f"""with b as ({FOUR_HOURS_SQL}) from (pivot (select open_time, 'close_' || symbol as name, close from b) on name using round(max(close), 4) group by open_time)"""


def j07_next_day_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Returns of consecutive calendar days: correlation and shares of continuation and reversal per symbol and weekday."""
    order = Window.partitionBy("symbol").orderBy("open_time")
    rows = daily(spark, folder).withColumn("ret", F.try_divide("close", F.lag("close").over(order)) - 1).where("ret is not null")
    rows = rows.withColumns({"nxt": F.lead("ret").over(order), "next_at": F.lead("open_time").over(order)}).where("datediff(next_at, open_time) = 1")
    same = F.signum("ret") == F.signum("nxt")
    return rows.groupBy("symbol", F.weekday("open_time").cast("long").alias("dow")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(same, 1.0).otherwise(0.0)), 6).alias("continuation"), F.round(correlation.safe_corr("ret", "nxt"), 6).alias("corr")
    )


J07_SQL = f"""with b as ({DAILY_SQL}), r as (select *, close / lag(close) over (partition by symbol order by open_time) - 1 as ret from b), p as (select * from r where ret is not null),
 q as (select a.symbol, isodow(a.open_time) - 1 as dow, a.ret, n.ret as nxt from p a join p n on n.symbol = a.symbol and n.open_time = a.open_time + interval 1 day)
 select symbol, dow, count(*) as n, round(avg(case when sign(ret) = sign(nxt) then 1.0 else 0.0 end), 6) as continuation,
 round(covar_samp(ret, nxt) / nullif(stddev_samp(ret) * stddev_samp(nxt), 0), 6) as corr from q group by 1, 2"""


def s09_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The latest order of each customer, as left by upserts in order of date and key."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return joins.latest_versions(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


S09_SQL = "select o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"


def s21_partial_update(spark: SparkSession, folder: str) -> DataFrame:
    """Customers updated from orders where there is something new, else kept as they were."""
    stored = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    high = F.when(F.max("o_totalprice") > 400_000, F.lit("KEY ACCOUNT"))
    news_rows = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(high.alias("c_mktsegment"), F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    return joins.upserted(stored, news_rows, ["c_custkey"], partial=True)


S21_SQL = """with n as (select o_custkey, case when max(o_totalprice) > 400000 then 'KEY ACCOUNT' end as seg, round(sum(o_totalprice), 2) as bal from orders group by 1)
 select coalesce(c_custkey, o_custkey) as c_custkey, coalesce(seg, c_mktsegment) as c_mktsegment, coalesce(bal, c_acctbal) as c_acctbal from customer full join n on c_custkey = o_custkey"""


def s14_retained(spark: SparkSession, folder: str) -> DataFrame:
    return joins.retained(table(spark, folder, "events"), "ts", 7).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


S14_SQL = "select event_type, count(*) as n, min(event_id) as first_id from events where ts > (select max(ts) from events) - interval 7 day group by 1"


def s12_title_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "news_items").where("title is not null").select("title", "news_id", "source")
    return joins.first_wins(rows, "title", ["news_id", "source"])


S12_SQL = "select title, news_id, source from news_items where title is not null qualify row_number() over (partition by title order by news_id, source nulls first) = 1"


def u01_unpivot_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per status turned long and then wide by priority."""
    sums = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.count("*").cast("double").alias("orders_n"))
    long = sums.unpivot(["o_orderstatus", "o_orderpriority"], ["mean_price", "orders_n"], "metric", "value")
    wide = long.groupBy("o_orderstatus", "metric").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("value"))
    return wide.select("o_orderstatus", "metric", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


U01_SQL = """with s as (select o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) as mean_price, cast(count(*) as double) as orders_n from orders group by 1, 2),
 l as (select o_orderstatus, o_orderpriority, 'mean_price' as metric, mean_price as value from s union all select o_orderstatus, o_orderpriority, 'orders_n', orders_n from s)
 select o_orderstatus, metric, max(case when o_orderpriority = '1-URGENT' then value end) as urgent, max(case when o_orderpriority = '5-LOW' then value end) as low from l group by 1, 2"""


def r03_detected_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent step between bars of a symbol, the number of gaps beyond 1.5 median steps and the longest step."""
    order = Window.partitionBy("symbol").orderBy("open_time")
    steps = four_hours(spark, folder).select("symbol", F.timestamp_diff("SECOND", F.lag("open_time").over(order), F.col("open_time")).alias("s")).where("s is not null")
    typical = steps.groupBy("symbol").agg(F.mode("s", True).alias("step_s"), F.median("s").alias("median_s"), F.max("s").alias("longest_s"))
    gaps = steps.join(typical, "symbol").groupBy("symbol").agg(F.count_if(F.col("s") > 1.5 * F.col("median_s")).alias("gaps"))
    return typical.join(gaps, "symbol").select("symbol", "step_s", "longest_s", "gaps")


R03_SQL = f"""with b as ({FOUR_HOURS_SQL}), s as (select symbol, date_diff('second', lag(open_time) over (partition by symbol order by open_time), open_time) as s from b),
 t as (select symbol, mode(s) as step_s, median(s) as med, max(s) as longest_s from s where s is not null group by 1)
 select t.symbol, step_s, longest_s, count(*) filter (s > 1.5 * med) as gaps from t join s on t.symbol = s.symbol and s.s is not null group by 1, 2, 3"""


def r02_resampled(spark: SparkSession, folder: str) -> DataFrame:
    """Four-hour bars resampled to days: first, highest, lowest, last, total."""
    day = F.date_trunc("day", F.col("open_time")).cast("timestamp_ntz")
    return four_hours(spark, folder).groupBy("symbol", day.alias("day_start")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume")
    )


R02_SQL = f"""with b as ({FOUR_HOURS_SQL}) select symbol, cast(date_trunc('day', open_time) as timestamp) as day_start, min_by(open, open_time) as open, max(high) as high, min(low) as low,
 max_by(close, open_time) as close, sum(volume) as volume from b group by 1, 2"""


def r04_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars to weeks from Monday to Sunday, labelled with the Sunday before."""
    label = F.date_sub(F.to_date(F.date_trunc("week", F.col("open_time"))), 1).alias("week_label")
    return daily(spark, folder).groupBy("symbol", label).agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"))


R04_SQL = f"""with b as ({DAILY_SQL}) select symbol, cast(date_trunc('week', open_time) as date) - 1 as week_label, min_by(open, open_time) as open, max(high) as high, min(low) as low,
 max_by(close, open_time) as close from b group by 1, 2"""


def f09_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of what is wrong with raw bars, one row per issue, from one aggregation over the whole table."""
    bars = table(spark, folder, "btc_klines")
    checks = {
        "rows": F.lit(True), "null_close": F.col("close").isNull(), "null_volume": F.col("volume").isNull(), "high_below_low": F.col("high") < F.col("low"),
        "close_outside": (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")), "open_outside": (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")),
        "price_not_positive": F.least("open", "high", "low", "close") <= 0, "zero_volume": F.col("volume") == 0, "negative_volume": F.col("volume") < 0, "not_closed": ~F.col("is_closed"),
    }
    sums = bars.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")


F09_SQL = "select * from (select count(*) as rows, count(*) filter (close is null) as null_close, count(*) filter (volume is null) as null_volume, count(*) filter (high < low) as high_below_low, count(*) filter (close > high or close < low) as close_outside, count(*) filter (open > high or open < low) as open_outside, count(*) filter (least(open, high, low, close) <= 0) as price_not_positive, count(*) filter (volume = 0) as zero_volume, count(*) filter (volume < 0) as negative_volume, count(*) filter (not is_closed) as not_closed from btc_klines) unpivot (n for issue in (rows, null_close, null_volume, high_below_low, close_outside, open_outside, price_not_positive, zero_volume, negative_volume, not_closed))"


# --- aggregates, correlation

A = "lag(close) over (partition by symbol order by open_time)"
RET_SQL = f"select *, close / nullif({A}, 0) - 1 as ret from b"
SAFE = "covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)"

A01_SQL = f"""with b as ({DAILY_SQL}), r as ({RET_SQL}) select symbol, isodow(open_time) - 1 as dow, count(*) as n, round(avg(ret), 6) as mean_ret, round(median(ret), 6) as median_ret, round(stddev_samp(ret), 6) as std_ret,
 round(max(ret), 6) as max_ret, round(min(ret), 6) as min_ret, round(avg(case when ret > 0 then 1.0 else 0.0 end), 6) as up_share, round(avg(case when ret < 0 then 1.0 else 0.0 end), 6) as down_share, round(avg(close), 6) as mean_close
 from r where ret is not null group by 1, 2"""
A02_SQL = f"""with b as ({DAILY_SQL}), m as (select symbol, year(open_time) y, month(open_time) m, min_by(close, open_time) a, max_by(close, open_time) z from b group by 1, 2, 3),
 e as (select symbol, m, count(*) as years, avg(z / nullif(a, 0) - 1) as mr, stddev_samp(z / nullif(a, 0) - 1) as sr from m group by 1, 2),
 w as (select *, (mr - avg(mr) over (partition by symbol)) / nullif(stddev_pop(mr) over (partition by symbol), 0) as zs from e)
 select symbol, m as month_no, years, round(mr, 6) as mean_ret, round(sr, 6) as std_ret, round(zs, 6) as z, case when abs(zs) > 1.96 then 1 else 0 end as significant from w"""
A03_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as (select *, abs(ln(close) - ln({A})) as x from b where close > 0), l as (
 select symbol, x, 'hour' as season, hour(open_time) as slot from r union all select symbol, x, 'weekday', isodow(open_time) - 1 from r union all select symbol, x, 'day', day(open_time) from r union all select symbol, x, 'month', month(open_time) from r)
 select symbol, season, slot, count(*) as n, round(avg(x), 6) as mean_abs_ret from l where x is not null group by 1, 2, 3"""
A06_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as ({RET_SQL}), q as (select *, sum(ret) over (partition by symbol order by open_time rows unbounded preceding) as total from r where ret is not null),
 d as (select *, total - max(total) over (partition by symbol order by open_time rows unbounded preceding) as dd, quantile_cont(ret, 0.05) over (partition by symbol) as v95, quantile_cont(ret, 0.01) over (partition by symbol) as v99 from q)
 select symbol, round(min(v95), 6) as var_95, round(min(v99), 6) as var_99, round(avg(case when ret <= v95 then ret end), 6) as cvar_95, round(avg(case when ret <= v99 then ret end), 6) as cvar_99,
 round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 6) as sharpe, round(min(dd), 6) as max_drawdown from d group by 1"""
A10_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as (select *, sign(close - {A}) as side from b), f as (select *, case when side <> coalesce(lag(side) over (partition by symbol order by open_time), 9) then 1 else 0 end as fresh from r where side is not null),
 g as (select *, sum(fresh) over (partition by symbol order by open_time rows unbounded preceding) as run from f), h as (select symbol, run, count(*) as bars, max(side) as side from g group by 1, 2)
 select symbol, count(*) as runs, max(bars) as longest, round(avg(bars), 6) as mean_bars, max_by(bars, run) as current_bars, cast(max_by(side, run) as bigint) as current_side from h group by 1"""
A09_SQL = f"""with s as ({CATALOG["y05_bull_bear"].sql(DAILY_SQL)}), b as ({DAILY_SQL}), j as (select s.symbol, s.cycle_no, s.is_bull, b.open_time, b.close from s join b on s.symbol = b.symbol and s.open_time = b.open_time where s.is_bull is not null)
 select symbol, cycle_no, max(is_bull) as is_bull, min(open_time) as start_at, max(open_time) as end_at, count(*) as bars, min_by(close, open_time) as start_close, max_by(close, open_time) as end_close, max(close) as max_close, min(close) as min_close,
 round(max_by(close, open_time) / nullif(min_by(close, open_time), 0) - 1, 6) as roi from j group by 1, 2"""


def a09_cycle_table(spark: SparkSession, folder: str) -> DataFrame:
    bars = daily(spark, folder)
    states = CATALOG["y05_bull_bear"].apply(bars).select("symbol", "open_time", "is_bull", "cycle_no")
    return seasonality.cycle_table(states.join(bars.select("symbol", "open_time", "close"), ["symbol", "open_time"]))


MEASURES_SQL = f"""b as ({FOUR_HOURS_SQL}), r as ({RET_SQL}), ms as (select symbol, open_time, close as price, volume, ret, case when count(ret) over w >= 14 then stddev_samp(ret) over w end as vol from r
 window w as (partition by symbol order by open_time rows 13 preceding)), pr as (select a.symbol as symbol_a, c.symbol as symbol_b, a.open_time, {", ".join(f"a.{m} as {m}_a, c.{m} as {m}_b" for m in ("price", "volume", "ret", "vol"))}
 from ms a join ms c on a.open_time = c.open_time and a.symbol < c.symbol)"""
_PAIR = ", ".join(
    f"round(covar_samp({m}_a, {m}_b) / nullif(stddev_samp(case when {m}_b is not null then {m}_a end) * stddev_samp(case when {m}_a is not null then {m}_b end), 0), 6) as corr_{m}" for m in ("price", "volume", "ret", "vol")
)
X01_SQL = f"with {MEASURES_SQL} select symbol_a, symbol_b, count(*) as n, {_PAIR} from pr group by 1, 2"
X02_SQL = f"""with b as ({FOUR_HOURS_SQL}), p as (select a.symbol as symbol_a, c.symbol as symbol_b, a.close as x, c.close as y from b a join b c on a.open_time = c.open_time and a.symbol < c.symbol),
 k as (select *, rank() over (partition by symbol_a, symbol_b order by x) + (count(*) over (partition by symbol_a, symbol_b, x) - 1) / 2.0 as rx, rank() over (partition by symbol_a, symbol_b order by y) + (count(*) over (partition by symbol_a, symbol_b, y) - 1) / 2.0 as ry from p)
 select symbol_a, symbol_b, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) as spearman from k group by 1, 2"""
X06_SQL = f"""with {MEASURES_SQL}, q as (select * from pr where ret_a is not null and ret_b is not null), c as (select *, case when count(*) over w >= 20 then covar_samp(ret_a, ret_b) over w / nullif(stddev_samp(ret_a) over w * stddev_samp(ret_b) over w, 0) end as corr,
 case when count(*) over w >= 20 then covar_samp(ret_a, ret_b) over w / nullif(var_samp(ret_b) over w, 0) end as beta from q window w as (partition by symbol_a, symbol_b order by open_time rows 19 preceding))
 select symbol_a, symbol_b, open_time, round(corr, 6) as corr, round(beta, 6) as beta, case when abs(corr - lag(corr) over (partition by symbol_a, symbol_b order by open_time)) > 0.3 then 1 else 0 end as breakdown from c"""
X10_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as ({RET_SQL}), s as ({" union all ".join(f"select symbol as leader, open_time, {k} as k, lag(ret, {k}) over (partition by symbol order by open_time) as x from r" for k in (1, 2, 3, 6))})
 select r.symbol as target, leader, k as lag_bars, count(*) as n, round(covar_samp(ret, x) / nullif(stddev_samp(ret) * stddev_samp(x), 0), 6) as corr from r join s on r.open_time = s.open_time and r.symbol <> leader
 where ret is not null and x is not null group by 1, 2, 3 having count(*) >= 10"""
V09_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as (select symbol, open_time, power(ln(close) - ln({A}), 2) as x from b where close > 0), d as (select *, x - avg(x) over (partition by symbol) as d from r where x is not null),
 p as (select symbol, d * d as d2, {", ".join(f"d * lag(d, {k}) over (partition by symbol order by open_time) as p{k}" for k in range(1, 31))} from d), s as (select symbol, sum(d2) as d2, {", ".join(f"sum(p{k}) as p{k}" for k in range(1, 31))} from p group by 1)
 {" union all ".join(f"select symbol, {k} as lag_bars, round(p{k} / nullif(d2, 0), 6) as acf from s" for k in range(1, 31))}"""
P04_SQL = f"""with b as ({FOUR_HOURS_SQL}), n as (select * from b qualify row_number() over (partition by symbol order by open_time desc) <= 30), s as (select symbol, max(high) t, min(low) l, max_by(open_time, high) ta, min_by(open_time, low) la from n group by 1),
 e as (select *, unnest([0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.414, 1.618, 2.0, 2.618]::double[]) as level from s)
 select symbol, level, round(case when la < ta then t - level * (t - l) else l + level * (t - l) end, 6) as price, case when la < ta then 1 else 0 end as rising from e"""
P07_SQL = f"""with b as ({FOUR_HOURS_SQL}), k as (select *, row_number() over (partition by symbol order by open_time desc) as rk from b), n as (select *, cast(20 - rk as double) as x, abs(close - {A}) as step from k where rk <= 20)
 select symbol, round(regr_slope(close, x), 6) as slope, round(regr_intercept(close, x), 6) as intercept, round(regr_r2(close, x), 6) as r2, round(max_by(close, x) / min_by(close, x) - 1, 6) as speed,
 round(abs(max_by(close, x) - min_by(close, x)) / nullif(sum(step), 0), 6) as efficiency, round(avg(case when rk <= 5 then volume end) / avg(volume), 6) as volume_factor from n group by 1"""

# --- text

WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{M}]+)', 1)"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


N01_SQL = f"""with w as (select doc_id, {WORDS_SQL} as ws from documents), c as (select doc_id, len(list_filter(ws, lambda x: list_contains({_listed(news.POSITIVE)}, x))) as pos, len(list_filter(ws, lambda x: list_contains({_listed(news.NEGATIVE)}, x))) as neg from w),
 s as (select *, round(coalesce((pos - neg) / nullif(pos + neg, 0), 0), 6) as score from c) select doc_id, pos, neg, score, case when score > 0.2 then 'positive' when score < -0.2 then 'negative' else 'neutral' end as label from s"""
N07_SQL = f"""with w as (select doc_id, list_filter({WORDS_SQL}, lambda x: length(x) > 2 and not list_contains({_listed(news.STOP_WORDS)}, x)) as ws from documents) select doc_id, coalesce(array_to_string(ws, ' '), '') as words, len(ws) as n_words from w"""
KEYWORDS = ["treasury", "bridge", "audit"]


def s06_backfill_slices(spark: SparkSession, folder: str) -> DataFrame:
    return registry.window_slices(spark, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "10 days")


S06_SQL = "select slice_start, least(slice_start + interval 10 day, timestamp '2024-02-01 00:00:00') as slice_end from (select unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-31 23:59:59', interval 10 day)) as slice_start)"


def s17_analysis_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = news.sentiment(table(spark, folder, "documents")).join(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return registry.analysis_json(rows, "text")


def l02_principal_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of three volatilities of every bar. With many ticks a bar few windows are without a price of 0, so those bars are left out of means."""
    rows = volatility(gaps=True).apply(four_hours(spark, folder))
    return models.principal_components(rows, ["hist_vol_14", "parkinson_14", "garman_klass_14"])


def w16_feature_frame(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.run_steps(four_hours(spark, folder), ["drop_duplicates", "repair", "features"])


def o01_outlier_flags(spark: SparkSession, folder: str) -> DataFrame:
    found = pipeline.run_steps(four_hours(spark, folder), ["outlier_flags"])
    return found.select("symbol", "open_time", F.col("is_outlier").cast("long").alias("is_outlier"))


O01_SQL = f"""with a as ({twin("o02_robust_outliers", FOUR_HOURS_SQL)}), r as ({twin("o05_domain_rules", FOUR_HOURS_SQL)}) select a.symbol, a.open_time, greatest(anomaly_z_close, anomaly_z_volume, anomaly_iqr_close, anomaly_iqr_volume,
 anomaly_jump, anomaly_price, anomaly_ohlc, anomaly_zero_volume, anomaly_negative_volume, anomaly_volume, anomaly_flash, anomaly_reversal, anomaly_gap) as is_outlier from a join r on a.symbol = r.symbol and a.open_time = r.open_time"""


def w16_sql() -> str:
    """The groups' twins side by side, over bars that the pipeline has repaired; a name that two groups have counts once."""
    cleaned = f"select f.symbol, f.open_time, b.open, f.high_clean as high, f.low_clean as low, f.close_clean as close, f.volume_clean as volume from ({CATALOG['f05_repaired'].sql(FOUR_HOURS_SQL)}) f join ({FOUR_HOURS_SQL}) b on f.symbol = b.symbol and f.open_time = b.open_time"
    seen, columns, joins_ = {"symbol", "open_time", "open", "high", "low", "close", "volume"}, [], []
    for k, group in enumerate([*pipeline.GROUPS, "w10_targets"]):
        plan = CATALOG[group]
        names = [c for stage in plan.stages for c in stage if c not in plan.hidden and c not in seen]
        if group == "w10_targets":
            names = ["target_return"]
        seen |= set(names)
        columns += [f"g{k}.{c}" for c in names]
        joins_.append(f"join ({twin(group, 'select * from cleaned') if group in TWINS else plan.sql('select * from cleaned')}) g{k} on g{k}.symbol = c.symbol and g{k}.open_time = c.open_time")
    return f"with cleaned as ({cleaned}) select c.symbol, c.open_time, c.open, c.high, c.low, c.close, c.volume, {', '.join(columns)} from cleaned c {' '.join(joins_)} where target_return is not null"


def queries() -> dict[str, Query]:
    named = [
        s06_backfill_slices, s17_analysis_json, w16_feature_frame, o01_outlier_flags, l02_principal_components,
        j05_asof_events, y01_event_cycles, j06_near_events, j01_aligned, j02_wide_panel, j07_next_day_pairs, s09_upsert, s21_partial_update, s14_retained, s12_title_dedup,
        u01_unpivot_pivot, r03_detected_interval, r02_resampled, r04_weekly, f09_integrity, a09_cycle_table,
    ]
    vol = lambda s, d: CATALOG["v01_volatility"].apply(four_hours(s, d))
    lagged = lambda s, d: CATALOG["w01_lagged"].apply(four_hours(s, d)).join(CATALOG["w10_targets"].apply(four_hours(s, d)).select("symbol", "open_time", "target_return"), ["symbol", "open_time"])
    columns = ["close_lag_1", "close_lag_3", "volume_lag_1"]
    documents = lambda s, d: table(s, d, "documents")
    return {f.__name__: f for f in named} | {
        "a01_weekday_stats": lambda s, d: seasonality.weekday_stats(daily(s, d)),
        "a02_monthly_stats": lambda s, d: seasonality.monthly_stats(daily(s, d)),
        "a03_volatility_seasons": lambda s, d: seasonality.volatility_seasons(four_hours(s, d)),
        "a06_risk": lambda s, d: seasonality.risk(four_hours(s, d)),
        "a10_trend_runs": lambda s, d: seasonality.trend_runs(four_hours(s, d)),
        "r05_fibonacci": lambda s, d: seasonality.fibonacci(four_hours(s, d)),
        "r07_trend_metrics": lambda s, d: seasonality.trend_metrics(four_hours(s, d)),
        "x01_correlation_matrix": lambda s, d: correlation.correlation_matrix(four_hours(s, d)),
        "x02_rank_correlation": lambda s, d: correlation.rank_correlation(four_hours(s, d)),
        "x06_rolling_pairs": lambda s, d: correlation.rolling_pairs(four_hours(s, d)),
        "x10_leading_indicators": lambda s, d: correlation.leading_indicators(four_hours(s, d)),
        "v09_volatility_clustering": lambda s, d: correlation.autocorrelation(four_hours(s, d)),
        "n01_sentiment": lambda s, d: news.sentiment(documents(s, d)),
        "n03_mentions": lambda s, d: news.mentions(documents(s, d)),
        "n03_named_mentions": lambda s, d: news.named_mentions(documents(s, d)),
        "n04_importance": lambda s, d: news.importance(documents(s, d)),
        "n05_topics": lambda s, d: news.topics(documents(s, d)),
        "n07_cleaned_words": lambda s, d: news.cleaned_words(documents(s, d)),
        "n08_cosine": lambda s, d: news.cosine(table(s, d, "embeddings")),
        "f11_keyword_hits": lambda s, d: news.keyword_hits(documents(s, d), KEYWORDS, 2),
        "a14_topic_trends": lambda s, d: news.topic_trends(documents(s, d), "published_at"),
        "g06_stationarity": lambda s, d: models.stationarity(daily(s, d)),
        "g09_seasonality": lambda s, d: models.seasonality(four_hours(s, d)),
        "g12_arima_forecast": lambda s, d: models.arima_forecast(four_hours(s, d)),
        "g15_rolling_validation": lambda s, d: models.rolling_validation(four_hours(s, d)),
        "g16_residual_tests": lambda s, d: models.residual_tests(four_hours(s, d)),
        "v12_garch": lambda s, d: models.garch(four_hours(s, d)),
        "o04_isolation_scores": lambda s, d: models.isolation_scores(four_hours(s, d)),
        "v07_regimes": lambda s, d: models.regimes(vol(s, d), "hist_vol_14"),
        "x11_return_regression": lambda s, d: models.return_regression(lagged(s, d), columns, "target_return"),
        "l01_feature_scores": lambda s, d: models.feature_scores(lagged(s, d), columns, "target_return"),
        "n06_topic_model": lambda s, d: learning.topic_model(documents(s, d)),
        "n09_news_clusters": lambda s, d: learning.news_clusters(documents(s, d)),
        "l04_embedding_clusters": lambda s, d: learning.embedding_clusters(table(s, d, "embeddings")),
        "l11_tuned_regression": lambda s, d: learning.tuned_regression(lagged(s, d), columns, "target_return"),
        "l12_permutation_importance": lambda s, d: learning.permutation_importance(lagged(s, d), columns, "target_return"),
        "l05_sequences": lambda s, d: models.sequences(four_hours(s, d), ["close", "volume"]),
    }


L01_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as (select symbol, open_time, {", ".join(f"lag({c}, {k}) over w as {c}_lag_{k}" for c, k in (("close", 1), ("close", 3), ("volume", 1)))}, lead(close, 3) over w / nullif(close, 0) - 1 as y from b window w as (partition by symbol order by open_time)),
 q as (select round(close_lag_1, 6) as close_lag_1, round(close_lag_3, 6) as close_lag_3, round(volume_lag_1, 6) as volume_lag_1, round(y, 6) as y from r where close_lag_1 is not null and close_lag_3 is not null and volume_lag_1 is not null and y is not null),
 c as ({" union all ".join(f"select '{c}' as feature, covar_samp({c}, y) / nullif(stddev_samp({c}) * stddev_samp(y), 0) as r, count(*) as n from q" for c in ("close_lag_1", "close_lag_3", "volume_lag_1"))})
 select feature, round(r, 6) as r, round(r * r / nullif(1 - r * r, 0) * (n - 2), 4) as f_score from c"""
L05_SQL = f"""with b as ({FOUR_HOURS_SQL}), r as (select *, row_number() over (partition by symbol order by open_time) - 1 as rn, count(*) over (partition by symbol) as total from b)
 select r.symbol || '-' || s.start as sequence_id, r.symbol, rn - s.start as position, close, volume from r, (select unnest(range(0, 100000, 10)) as start) s where rn >= s.start and rn < s.start + 30 and s.start + 30 <= total"""


def oracle_sql() -> dict[str, str]:
    low = "lower(coalesce(text, ''))"
    coins = " union all ".join(f"select doc_id, '{c}' as coin, len(regexp_extract_all({low}, '\\b(?:{p})\\b')) as n from documents" for c, p in news.COINS.items())
    hits = lambda words: " + ".join(f"case when regexp_matches({low}, '\\b{w}\\b') then 1 else 0 end" for w in words)
    topics = " union all ".join(f"select doc_id, '{t}' as topic, least(1.0, 2.0 * ({hits(p.split('|'))}) / {len(p.split('|'))}) as score from documents" for t, p in news.TOPICS.items())
    coin_weight = " + ".join(f"case when regexp_matches({low}, '\\b(?:{news.COINS[c]})\\b') then {w} else 0 end" for c, w in (("BTC", 0.3), ("ETH", 0.25), ("SOL", 0.15)))
    market = " + ".join(f"case when regexp_matches({low}, '\\b{w}\\b') then 1.0 else 0 end" for w in news.TOPICS["markets"].split("|"))
    n05 = f"with t as ({topics}) select doc_id, topic, round(cast(score as double), 6) as score, row_number() over (partition by doc_id order by score desc, topic) as place from t where score > 0 qualify place <= 3"
    return {
        "j05_asof_events": J05_SQL, "y01_event_cycles": Y01_SQL, "j06_near_events": J06_SQL, "j01_aligned": J01_SQL, "j02_wide_panel": J02_SQL, "j07_next_day_pairs": J07_SQL, "s09_upsert": S09_SQL,
        "s21_partial_update": S21_SQL, "s14_retained": S14_SQL, "s12_title_dedup": S12_SQL, "u01_unpivot_pivot": U01_SQL, "r03_detected_interval": R03_SQL, "r02_resampled": R02_SQL, "r04_weekly": R04_SQL,
        "f09_integrity": F09_SQL, "a01_weekday_stats": A01_SQL, "a02_monthly_stats": A02_SQL, "a03_volatility_seasons": A03_SQL, "a06_risk": A06_SQL, "a09_cycle_table": A09_SQL, "a10_trend_runs": A10_SQL,
        "r05_fibonacci": P04_SQL, "r07_trend_metrics": P07_SQL, "x01_correlation_matrix": X01_SQL, "x02_rank_correlation": X02_SQL, "x06_rolling_pairs": X06_SQL, "x10_leading_indicators": X10_SQL,
        "v09_volatility_clustering": V09_SQL, "n01_sentiment": N01_SQL, "n03_mentions": f"select * from ({coins}) where n > 0", "n05_topics": n05,
        "n03_named_mentions": """with m as (select doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}]+)', 1), lambda x: x like '_%coin')) as coin from documents), c as (select doc_id, coin, count(*) as n from m group by 1, 2)
 select *, cast(row_number() over (partition by doc_id order by n desc, coin) = 1 as bigint) as is_top from c""", "n07_cleaned_words": N07_SQL,
        "n04_importance": f"""with d as ({N01_SQL}), x as (select doc_id, {coin_weight} + 0.4 * least({market}, 3.0) / 3 + case when regexp_matches({low}, '\\b(?:{news.ENTITIES})\\b') then 0.15 else 0 end as base from documents)
 select x.doc_id, round(cast(least(1.0, base + 0.2 * coalesce(abs((pos - neg) / nullif(pos + neg, 0)), 0)) as double), 6) as importance from x join d on x.doc_id = d.doc_id""",
        "n08_cosine": """with p as (select vec_id as probe_id, embedding::double[] as p from embeddings where vec_id % 100 = 0) select vec_id, probe_id,
 round(list_dot_product(embedding::double[], p) / nullif(sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(p, p)), 0), 5) as cosine from embeddings, p""",
        "f11_keyword_hits": f"select * from (select doc_id, len(regexp_extract_all({low}, '\\b(?:{'|'.join(KEYWORDS)})\\b')) as hits from documents) where hits >= 2",
        "a14_topic_trends": f"""with n as (select max(published_at) as newest from documents), b as (select doc_id, cast(floor(date_diff('second', published_at, newest) / 2592000) as bigint) as bucket from documents, n where published_at is not null),
 e as (select topic, bucket, count(*) as n, coalesce(sum(pos - neg) / nullif(sum(pos + neg), 0), 0) as mood from ({n05}) t join ({N01_SQL}) s on t.doc_id = s.doc_id join b on b.doc_id = t.doc_id group by 1, 2)
 select topic, bucket, n, round(mood, 6) as mood, round(case when lag(bucket) over w = bucket + 1 then mood - lag(mood) over w end, 4) as mood_change from e window w as (partition by topic order by bucket desc)""",
        "w16_feature_frame": w16_sql(), "s06_backfill_slices": S06_SQL, "o01_outlier_flags": O01_SQL, "l01_feature_scores": L01_SQL, "l05_sequences": L05_SQL,
    }
