"""Aggregates over news, forecasts, volatility and pairs of series, with DuckDB twins written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators import correlation, models, news, summaries, trend
from candlery.operators.features import CATALOG, volatility
from candlery.plans.candle_queries import DAILY_SQL as D
from candlery.plans.candle_queries import FOUR_HOURS_SQL, daily, four_hours
from candlery.plans.market_queries import K, bars
from candlery.plans.relation_queries import N01_SQL
from candlery.plans.trend_queries import TWINS as TREND
from candlery.plans.twins import twin, volatility_twin
from candlery.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
B = f"({FOUR_HOURS_SQL})"
W = "partition by symbol order by open_time"
MODELS = ("last", "mean5", "drift")
WEIGHTS = {"last": 0.6, "mean5": 0.3, "drift": 0.1}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Each news item once (the first of equal ids by its text), a row for each of its topics."""
    rows = table(spark, folder, "news_items").where("news_id is not null").select("news_id", "topics", "sentiment_score", "upvote_ratio").distinct()
    return rows.select("news_id", F.explode("topics").alias("item"), F.lit(1).alias("weight"), F.col("sentiment_score").alias("mood"), F.col("upvote_ratio").alias("importance")).distinct()


MENTIONS = "(select distinct news_id, item, mood, importance from (select news_id, unnest(topics) as item, sentiment_score as mood, upvote_ratio as importance from news_items where news_id is not null))"


def a11_trending(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.trending(_mentions(spark, folder)), 9)


A11_SQL = f"select item, count(*) as mentions, round(avg(mood), 9) as mood, round(avg(importance), 9) as importance, case when avg(mood) > 0.1 then 'positive' when avg(mood) < -0.1 then 'negative' else 'neutral' end as direction from {MENTIONS} group by 1 order by 2 desc, 1 limit 10"


def a12_market_signals(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.market_signals(_mentions(spark, folder), least_importance=0.5, strong=0.2, share=0.3))


A12_SQL = f"""with g as (select item, count(*) as n, count(*) filter (mood > 0.2) as up, count(*) filter (mood < -0.2) as down, avg(importance) as w from {MENTIONS} where importance >= 0.5 group by 1 having count(*) >= 2),
 s as (select *, case when up >= 0.3 * n and up >= 2 then 'bullish' when down >= 0.3 * n and down >= 2 then 'bearish' else 'neutral' end as signal from g)
 select item, signal, round(least(1.0, case signal when 'bullish' then up / n when 'bearish' then down / n else 0 end * w), 6) as strength, n, round(up / n, 6) as good, round(down / n, 6) as bad from s where signal <> 'neutral' or n >= 3 order by least(1.0, case signal when 'bullish' then up / n when 'bearish' then down / n else 0 end * w) desc, item limit 10"""


def _moods(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return news.sentiment(documents).join(documents.select("doc_id", F.coalesce("source", F.lit("")).alias("item"), F.col("published_at").alias("at")), "doc_id").select("item", "at", (1 + F.col("pos") + F.col("neg")).alias("weight"), F.col("score").alias("mood"))


MOODS = f"(select coalesce(source, '') as item, published_at as at_, 1 + pos + neg as weight, score as mood from ({N01_SQL}) s join documents d on s.doc_id = d.doc_id)"
A13 = f"select item, cast(floor(date_diff('second', at_, (select max(at_) from {MOODS})) / 2592000) as bigint) as window_no, count(*) as n, cast(sum(weight) as bigint) as weight, sum(mood * weight) / sum(weight) as mood from {MOODS} where at_ is not null group by 1, 2"


def a13_mood_windows(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.mood_windows(_moods(spark, folder), 2_592_000))


A13_SQL = f"select * replace (round(mood, 6) as mood) from ({A13})"


def a14_mood_trends(spark: SparkSession, folder: str) -> DataFrame:
    found = summaries.mood_trends(summaries.mood_windows(_moods(spark, folder), 2_592_000), change=0.001)
    return _rounded(found.withColumn("place", F.col("place").cast("long")), 5)


A14_SQL = f"""with w as ({A13}), k as (select window_no, row_number() over (order by window_no) as k from (select distinct window_no from w)), r as (select w.*, k from w join k using (window_no) where n >= 3),
 m as (select a.item, a.mood - b.mood as moved from r a join r b on a.item = b.item and b.k = a.k + 1), e as (select item, avg(moved) as mean_change, avg(abs(moved)) as volatility from m group by 1)
 select 'rising' as kind, row_number() over (order by mean_change desc, item) as place, item, round(mean_change, 5) as mean_change, round(volatility, 5) as volatility from e where mean_change > 0.001 qualify place <= 10
 union all select 'falling', row_number() over (order by mean_change, item) as place, item, round(mean_change, 5), round(volatility, 5) from e where mean_change < -0.001 qualify place <= 10
 union all select 'volatile', row_number() over (order by volatility desc, item) as place, item, round(mean_change, 5), round(volatility, 5) from e qualify place <= 10"""


def _forecasts(spark: SparkSession, folder: str) -> DataFrame:
    made = summaries.naive_forecasts(four_hours(spark, folder))
    return made.unionByName(summaries.ensemble(made, WEIGHTS))


FC = f"""n as (select symbol, open_time, close, row_number() over (w) as rn, lag(close) over (w) as l1, list(close) over (w rows between 5 preceding and 1 preceding) as l5, first(close) over (w) as c0 from {B} window w as ({W})),
 one as (select symbol, open_time, close as actual, 'last' as model, l1 as forecast from n union all select symbol, open_time, close, 'mean5', case when len(l5) = 5 then list_avg(l5) end from n union all select symbol, open_time, close, 'drift', case when rn > 2 then l1 + (l1 - c0) / (rn - 2) end from n),
 known as (select * from one where forecast is not null), f as (select * from known union all select symbol, open_time, any_value(actual), 'ensemble', sum(forecast * case model when 'last' then 0.6 when 'mean5' then 0.3 else 0.1 end) / sum(case model when 'last' then 0.6 when 'mean5' then 0.3 else 0.1 end) from known group by 1, 2)"""
_ACC = "count(*) as n, round(avg(pow(actual - forecast, 2)), 4) as mse, round(sqrt(avg(pow(actual - forecast, 2))), 4) as rmse, round(avg(abs(actual - forecast)), 4) as mae, round(100 * avg(abs((actual - forecast) / nullif(actual, 0))), 4) as mape, round(1 - sum(pow(actual - forecast, 2)) / nullif(var_pop(actual) * count(*), 0), 4) as r2"


def j13_forecast_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.forecast_accuracy(_forecasts(spark, folder), four_hours(spark, folder)), 4)


def j15_forecasts_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.forecasts_wide(_forecasts(spark, folder), four_hours(spark, folder), [*MODELS, "ensemble"]), 9)


J15_SQL = f"with {FC} select symbol, open_time, round(any_value(actual), 9) as actual, {', '.join(f'''round(max(forecast) filter (model = '{m}'), 9) as {m}''' for m in (*MODELS, 'ensemble'))} from f group by 1, 2"


def g17_compared_models(spark: SparkSession, folder: str) -> DataFrame:
    found = summaries.compared_models(_forecasts(spark, folder), four_hours(spark, folder))
    return _rounded(found.withColumn("place", F.col("place").cast("long")), 4)


G17_SQL = f"""with {FC}, m as (select *, forecast - lag(forecast) over w as df, actual - lag(actual) over w as da from f window w as (partition by symbol, model order by open_time)),
 g as (select symbol, model, avg(pow(actual - forecast, 2)) as mse, stddev_samp(df) / nullif(stddev_samp(da), 0) as fidelity from m group by 1, 2) select symbol, model, round(mse, 4) as mse, round(fidelity, 4) as fidelity, row_number() over (partition by symbol order by mse, model) as place from g"""


def a08_error_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.error_profile(_forecasts(spark, folder), four_hours(spark, folder)), 5)


A08_SQL = f"with {FC}, e as (select model, actual - forecast as e from f) select model, count(*) as n, round(avg(e), 5) as mean, round(stddev_samp(e), 5) as sd, round(skewness(e), 5) as skew, round(kurtosis(e), 5) as kurt, {', '.join(f'round(quantile_cont(abs(e), {q / 100}), 5) as p{q}' for q in (50, 75, 90, 95, 99))} from e group by 1"


def a15_training_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.training_summary(summaries.forecast_accuracy(_forecasts(spark, folder), four_hours(spark, folder))), 4)


A15_SQL = f"with {FC}, a as (select symbol, model, sqrt(avg(pow(actual - forecast, 2))) as rmse, avg(abs(actual - forecast)) as mae, 1 - sum(pow(actual - forecast, 2)) / nullif(var_pop(actual) * count(*), 0) as r2 from f group by 1, 2) select model, count(*) as n, {', '.join(f'round({g}({c}), 4) as {c}_{k}' for c in ('rmse', 'mae', 'r2') for k, g in (('mean', 'avg'), ('sd', 'stddev_pop'), ('min', 'min'), ('max', 'max')))} from a group by 1"


def a16_delivery_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "btc_klines").groupBy("venue").agg(F.count("*").alias("n_rows"), F.count_distinct("feed_id").alias("feeds"), F.sum("number_of_trades").alias("trades"), F.min("open_time").alias("first_at"), F.max("open_time").alias("last_at"))
    return rows


A16_SQL = "select venue, count(*) as n_rows, count(distinct feed_id) as feeds, cast(sum(number_of_trades) as bigint) as trades, min(open_time) as first_at, max(open_time) as last_at from btc_klines group by 1"


def a04_term_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Deviations of delivered bars by the length of a bar."""
    rows = summaries.frequency_volatility(bars(spark, folder), ["feed_id", "tf"])
    return _rounded(summaries.term_structure(rows, "tf", "volatility", 86_400), 5)


V15 = f"""(with r as (select feed_id, tf, open_time, case when close / nullif(p, 0) > 0 then ln(close / nullif(p, 0)) end as lr, epoch(open_time) - epoch(pt) as step from (select *, lag(close) over w as p, lag(open_time) over w as pt from {K} window w as (partition by feed_id, tf order by open_time))),
 s as (select feed_id, tf, median(step) as usual from r group by 1, 2), l as (select r.*, usual, list(lr) over (partition by r.feed_id, r.tf order by open_time rows 19 preceding) as ls from r join s on r.feed_id = s.feed_id and r.tf = s.tf)
 select feed_id, tf, open_time, case when len(list_filter(ls, lambda v: v is not null)) = 20 then list_stddev_samp(ls) * sqrt(case when usual <= 300 then 252 * 24 * 12 when usual <= 3600 then 252 * 24 else 252 end) end as volatility from l)"""
A04_SQL = f"with g as (select tf, avg(volatility) as mean, median(volatility) as median, max(volatility) as most, min(volatility) as least, stddev_samp(volatility) as sd from {V15} where volatility is not null group by 1) select tf, round(mean, 5) as mean, round(median, 5) as median, round(most, 5) as most, round(least, 5) as least, round(sd, 5) as sd, round(mean / (select mean from g where tf = 86400), 5) as ratio from g"


def v15_frequency_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.frequency_volatility(bars(spark, folder), ["feed_id", "tf"]), 5)


V15_SQL = f"select feed_id, tf, open_time, round(volatility, 5) as volatility from {V15}"


def v16_last_volatility(spark: SparkSession, folder: str) -> DataFrame:
    """Of each series the last rolling value and the plain mean of all."""
    rows = summaries.frequency_volatility(bars(spark, folder), ["feed_id", "tf"]).where("volatility is not null")
    return _rounded(rows.groupBy("feed_id", "tf").agg(F.max_by("volatility", "open_time").alias("last_value"), F.avg("volatility").alias("mean_value")), 5)


V16_SQL = f"select feed_id, tf, round(arg_max(volatility, open_time), 5) as last_value, round(avg(volatility), 5) as mean_value from {V15} where volatility is not null group by 1, 2"


def v06_compared_estimators(spark: SparkSession, folder: str) -> DataFrame:
    """Four estimators by three windows, side by side in long form."""
    made = volatility((14, 30, 60)).apply(four_hours(spark, folder))
    names = [f"{e}_{n}" for e in ("hist_vol", "parkinson", "garman_klass", "yang_zhang") for n in (14, 30, 60)]
    return _rounded(made.unpivot(["symbol"], names, "estimator", "v").where("v is not null").groupBy("symbol", "estimator").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"), F.max("v").alias("most")), 4)


V06_SQL = f"with v as ({volatility_twin((14, 30, 60)).replace('{b}', B)}), u as (unpivot (select * exclude (open_time, vol_of_vol, rel_vol, vol_breakout) from v) on columns(* exclude (symbol)) into name estimator value x) select symbol, estimator, count(*) as n, round(avg(x), 4) as mean, round(median(x), 4) as median, round(max(x), 4) as most from u group by 1, 2"


def v07_quantile_regimes(spark: SparkSession, folder: str) -> DataFrame:
    rows = CATALOG["v01_volatility"].apply(four_hours(spark, folder)).select("symbol", "open_time", "hist_vol_14")
    return summaries.quantile_regimes(rows, "hist_vol_14", 4).withColumn("regime", F.col("regime").cast("long"))


V07_SQL = f"with v as ({twin('v01_volatility', FOUR_HOURS_SQL)}), c as (select symbol, quantile_cont(hist_vol_14, [0.25, 0.5, 0.75]) as q from v group by 1) select v.symbol, open_time, hist_vol_14, cast(hist_vol_14 > q[1] as bigint) + cast(hist_vol_14 > q[2] as bigint) + cast(hist_vol_14 > q[3] as bigint) as regime from v join c using (symbol) where hist_vol_14 is not null"


def a17_market_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.market_snapshot(CATALOG["v01_volatility"].apply(four_hours(spark, folder))), 5)


A17_SQL = f"""with v as (select symbol, open_time, hist_vol_14 as v from ({twin('v01_volatility', FOUR_HOURS_SQL)}) where hist_vol_14 is not null), e as (select open_time, count(*) as n, avg(v) as mean, stddev_samp(v) as sd, arg_max(symbol, v) as wildest, arg_min(symbol, v) as calmest from v group by 1 order by open_time desc limit 30),
 p as (select a.symbol as sa, b.symbol as sb, covar_samp(a.v, b.v) / nullif(stddev_samp(a.v) * stddev_samp(b.v), 0) as r from v a join v b on a.open_time = b.open_time and a.symbol < b.symbol where a.open_time in (select open_time from e) group by 1, 2)
 select open_time, n, round(mean, 5) as mean, round(sd, 5) as sd, wildest, calmest, round(mean / (select mean from e order by open_time limit 1) - 1, 5) as change, round((select avg(r) from p), 5) as pair_corr from e order by open_time desc limit 1"""


def j04_left_aligned(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.left_aligned(four_hours(spark, folder), "view")


J04_SQL = f"with b as (select * from {B}), t as (select distinct open_time from b where symbol = 'view'), s as (select distinct symbol from b), k as (select s.symbol, t.open_time, b.close from s cross join t left join b on b.symbol = s.symbol and b.open_time = t.open_time) select symbol, open_time, last_value(close ignore nulls) over ({W} rows unbounded preceding) as close from k"


def x01_kendall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.kendall(daily(spark, folder)))


X01K_SQL = f"""with d as (select symbol, open_time, close from ({D})), p as (select a.symbol as symbol_a, b.symbol as symbol_b, a.open_time, a.close as x, b.close as y from d a join d b on a.open_time = b.open_time and a.symbol < b.symbol),
 s as (select m.symbol_a, m.symbol_b, sum(sign(n.x - m.x) * sign(n.y - m.y)) as score, sum(abs(sign(n.x - m.x))) as nx, sum(abs(sign(n.y - m.y))) as ny from p m join p n on m.symbol_a = n.symbol_a and m.symbol_b = n.symbol_b and m.open_time < n.open_time group by 1, 2), c as (select symbol_a, symbol_b, count(*) as n from p group by 1, 2)
 select s.symbol_a, s.symbol_b, n, round(score / nullif(sqrt(nx * ny), 0), 6) as tau from s join c using (symbol_a, symbol_b)"""


def x02_winsorised(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.pair_correlation(summaries.winsorised(four_hours(spark, folder)), "volume"))


def x05_pairs_beyond(spark: SparkSession, folder: str) -> DataFrame:
    """With a limit that pairs of these series reach."""
    rows = correlation.measures(four_hours(spark, folder)).where("ret is not null")
    return _rounded(summaries.strong_pairs(summaries.pair_correlation(rows, "ret"), 0.02))


_PAIR = "count(*) as n, covar_samp(a.{0}, b.{0}) / nullif(stddev_samp(a.{0}) * stddev_samp(b.{0}), 0) as corr"
X02_SQL = f"with b as (select * from {B}), s as (select symbol, avg(volume) + 3 * stddev_samp(volume) as hi, median(volume) as mid from b group by 1), v as (select b.symbol, open_time, case when volume > hi then mid else volume end as x from b join s using (symbol)), z as (select a.symbol as symbol_a, b.symbol as symbol_b, {_PAIR.format('x')} from v a join v b on a.open_time = b.open_time and a.symbol < b.symbol group by 1, 2) select symbol_a, symbol_b, n, round(corr, 6) as corr from z"
RET = f"(select symbol, open_time, close / nullif(lag(close) over ({W}), 0) - 1 as ret from {B})"
X05_SQL = f"with r as (select * from {RET} where ret is not null), z as (select a.symbol as symbol_a, b.symbol as symbol_b, {_PAIR.format('ret')} from r a join r b on a.open_time = b.open_time and a.symbol < b.symbol group by 1, 2) select symbol_a, symbol_b, n, round(corr, 6) as corr, case when corr > 0 then 'together' else 'opposed' end as kind from z where abs(corr) >= 0.02"


def x08_static_beta(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(summaries.static_beta(four_hours(spark, folder), "view"))


X08_SQL = f"with r as (select * from {RET} where ret is not null), p as (select a.symbol, a.ret as y, b.ret as x from r a join r b on a.open_time = b.open_time and b.symbol = 'view' and a.symbol <> 'view') select symbol, count(*) as n, round(covar_samp(x, y) / nullif(var_samp(x), 0), 6) as beta, round(avg(y) - covar_samp(x, y) / nullif(var_samp(x), 0) * avg(x), 6) as alpha, round(pow(corr(x, y), 2), 6) as r2 from p group by 1"


def x12_regime_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """By the regime of one symbol."""
    rows = four_hours(spark, folder)
    regimes = trend.market_regime(trend.trend_frame(rows)).where("symbol = 'view'")
    return _rounded(summaries.regime_correlations(rows, regimes), 5)


_M = f"(select symbol, open_time, close as price, volume, ret, case when count(ret) over ({W} rows 13 preceding) = 14 then stddev_samp(ret) over ({W} rows 13 preceding) end as vol from (select *, close / nullif(lag(close) over ({W}), 0) - 1 as ret from {B}))"


def _safe(m: str) -> str:
    f = f"filter (a.{m} is not null and b.{m} is not null)"
    return f"round(covar_samp(a.{m}, b.{m}) {f} / nullif(stddev_samp(a.{m}) {f} * stddev_samp(b.{m}) {f}, 0), 5) as corr_{m}"


X12_SQL = f"with g as ({TREND['r22_market_regime']}), m as (select * from {_M}) select g.regime, a.symbol as symbol_a, b.symbol as symbol_b, count(*) as n, {', '.join(map(_safe, ('price', 'volume', 'ret', 'vol')))} from m a join m b on a.open_time = b.open_time and a.symbol < b.symbol join g on g.open_time = a.open_time and g.symbol = 'view' group by 1, 2, 3"


def v13_impulse_response(spark: SparkSession, folder: str) -> DataFrame:
    """Variance after a shock of one deviation, by the persistence that was fitted to each symbol."""
    return models.impulse_response(models.garch(four_hours(spark, folder)))


TWINS = {
    "a11_trending": A11_SQL, "a12_market_signals": A12_SQL, "a13_mood_windows": A13_SQL, "a14_mood_trends": A14_SQL, "j13_forecast_accuracy": f"with {FC} select symbol, model, {_ACC} from f group by 1, 2", "j15_forecasts_by_model": J15_SQL,
    "g17_compared_models": G17_SQL, "a08_error_profile": A08_SQL, "a15_training_summary": A15_SQL, "a16_delivery_summary": A16_SQL, "a04_term_structure": A04_SQL, "v15_frequency_volatility": V15_SQL, "v16_last_volatility": V16_SQL,
    "v06_compared_estimators": V06_SQL, "v07_quantile_regimes": V07_SQL, "a17_market_snapshot": A17_SQL, "j04_left_aligned": J04_SQL, "x01_kendall": X01K_SQL, "x02_winsorised": X02_SQL, "x05_pairs_beyond": X05_SQL, "x08_static_beta": X08_SQL,
    "x12_regime_correlations": X12_SQL, "v13_impulse_response": "",
}


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in TWINS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in TWINS.items() if sql}
