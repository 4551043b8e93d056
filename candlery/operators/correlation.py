"""Correlation, beta and lead-lag between the returns of symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def _order() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def safe_corr(a: str, b: str, over: WindowSpec | None = None) -> Column:
    """Pearson correlation, null for fewer than two pairs or no spread."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    cov, sx, sy = (c if over is None else c.over(over) for c in (F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y)))
    spread = sx * sy
    return F.try_divide(cov, F.nullif(spread, F.lit(0.0)))


def measures(bars: DataFrame, window: int = 14) -> DataFrame:
    """symbol, open_time and what is correlated: price, volume, ret and vol (rolling standard deviation of ret)."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(_order())) - 1
    frame = _order().rowsBetween(-(window - 1), 0)
    rows = bars.select("symbol", "open_time", F.col("close").alias("price"), "volume", ret.alias("ret"))
    return rows.withColumn("vol", F.when(F.count("ret").over(frame) >= window, F.stddev_samp("ret").over(frame)))


def paired(rows: DataFrame) -> DataFrame:
    """Each pair of symbols (a < b) side by side at common times: an equi-join on time, bars being few per time."""
    names = [c for c in rows.columns if c not in ("symbol", "open_time")]
    a, b = (rows.select(F.col("symbol").alias(f"symbol_{s}"), "open_time", *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "ab")
    return a.join(b, "open_time").where("symbol_a < symbol_b")


def correlation_matrix(bars: DataFrame, window: int = 14) -> DataFrame:
    """symbol_a, symbol_b, n and the correlations of price, volume, returns and volatility."""
    pairs = paired(measures(bars, window))
    return pairs.groupBy("symbol_a", "symbol_b").agg(
        F.count("*").alias("n"), *[F.round(safe_corr(f"{m}_a", f"{m}_b"), 6).alias(f"corr_{m}") for m in ("price", "volume", "ret", "vol")]
    )


def rank_correlation(bars: DataFrame) -> DataFrame:
    """Spearman correlation of closes: Pearson on average ranks within each pair's common times."""
    pairs = paired(bars.select("symbol", "open_time", "close"))
    ranked = pairs
    for s in "ab":
        by_value = Window.partitionBy("symbol_a", "symbol_b").orderBy(f"close_{s}")
        same = Window.partitionBy("symbol_a", "symbol_b", f"close_{s}")
        ranked = ranked.withColumn(f"rank_{s}", F.rank().over(by_value) + (F.count("*").over(same) - 1) / 2.0)
    return ranked.groupBy("symbol_a", "symbol_b").agg(F.round(safe_corr("rank_a", "rank_b"), 6).alias("spearman"))


def rolling_pairs(bars: DataFrame, window: int = 20, jump: float = 0.3) -> DataFrame:
    """Rolling correlation of returns of each pair, rolling beta of a on b, and breakdowns (changes beyond ``jump``)."""
    pairs = paired(measures(bars).select("symbol", "open_time", "ret")).where("ret_a is not null and ret_b is not null")
    order = Window.partitionBy("symbol_a", "symbol_b").orderBy("open_time")
    frame = order.rowsBetween(-(window - 1), 0)
    full = F.count("*").over(frame) >= window
    rows = pairs.withColumn("corr", F.when(full, safe_corr("ret_a", "ret_b", frame)))
    beta = F.try_divide(F.covar_samp("ret_a", "ret_b").over(frame), F.nullif(F.var_samp("ret_b").over(frame), F.lit(0.0)))
    rows = rows.withColumns({"beta": F.when(full, beta), "corr_before": F.lag("corr").over(order)})
    broken = F.when(F.abs(F.col("corr") - F.col("corr_before")) > jump, 1).otherwise(0).cast("long")
    return rows.select("symbol_a", "symbol_b", "open_time", F.round("corr", 6).alias("corr"), F.round("beta", 6).alias("beta"), broken.alias("breakdown"))


def leading_indicators(bars: DataFrame, lags: Sequence[int] = (1, 2, 3, 6), least: int = 10) -> DataFrame:
    """Correlation of each symbol's return with every other one's return some bars earlier."""
    rows = measures(bars).select("symbol", "open_time", "ret")
    earlier = rows.select("symbol", "open_time", *[F.lag("ret", k).over(_order()).alias(f"x{k}") for k in lags])
    shifted = earlier.select("symbol", "open_time", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"x{k}").alias("x")) for k in lags])).alias("s"))
    leaders = shifted.select(F.col("symbol").alias("leader"), "open_time", "s.k", "s.x")
    both = rows.join(leaders, "open_time").where("symbol <> leader and ret is not null and x is not null")
    return both.groupBy(F.col("symbol").alias("target"), "leader", F.col("k").alias("lag_bars")).agg(F.count("*").alias("n"), F.round(safe_corr("ret", "x"), 6).alias("corr")).where(f"n >= {least}")


def autocorrelation(bars: DataFrame, value: str = "squared", lags: int = 30) -> DataFrame:
    """Biased autocorrelation of squared log returns (volatility clustering) or of log returns at lags 1.. per symbol."""
    step = F.ln("close") - F.ln(F.lag("close").over(_order()))
    rows = bars.where("close > 0").select("symbol", "open_time", step.alias("r")).where("r is not null")
    rows = rows.select("symbol", "open_time", (F.col("r") * F.col("r") if value == "squared" else F.col("r")).alias("x"))
    centred = rows.withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy("symbol")))
    order = Window.partitionBy("symbol").orderBy("open_time")
    products = centred.select("symbol", (F.col("d") * F.col("d")).alias("d2"), *[(F.col("d") * F.lag("d", k).over(order)).alias(f"p{k}") for k in range(1, lags + 1)])
    sums = products.groupBy("symbol").agg(F.sum("d2").alias("d2"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, lags + 1)])
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("lag_bars"), F.round(F.try_divide(F.col(f"p{k}"), F.nullif(F.col("d2"), F.lit(0.0))), 6).alias("acf")) for k in range(1, lags + 1)])
    return sums.select("symbol", F.explode(each).alias("e")).select("symbol", "e.*")
