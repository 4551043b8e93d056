"""Trend of a series at every bar: votes, strength, regimes, divergences, breakouts, and what models take of them.

Everything at a bar comes from bars up to it. Exponential means come from the recursive kernels, all else from windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlery.functions.sqlwin import WC, Features, W, frame, ratio, roll
from candlery.operators.features import CATALOG, atr_adx
from candlery.operators.recursive import recursive_indicators

KEY = ["symbol", "open_time"]
#: Regimes by code, as models take them.
REGIMES = (
    "insufficient_data", "strong_uptrend_high_volatility", "strong_downtrend_high_volatility", "strong_uptrend_normal_volatility", "strong_downtrend_normal_volatility", "emerging_uptrend", "emerging_downtrend",
    "moderate_trend", "accumulation_before_breakout", "consolidation", "low_volatility_sideways", "high_volatility_range", "choppy_market",
)


def _order(*more: str):
    return Window.partitionBy("symbol", *more).orderBy("open_time")


def trend_frame(bars: DataFrame) -> DataFrame:
    """Bars with directional indexes, means, bands, exponential indicators and running regression."""
    plain = Features(
        [
            {"sma7": roll("avg", "close", 7), "sma14": roll("avg", "close", 14), "sma20": roll("avg", "close", 20), "sd20": roll("stddev_samp", "close", 20), "mean_close": f"avg(close) over {WC}", "rn": f"row_number() over ({W})"},
            {"volume20": roll("avg", "volume", 20), "volume5": f"avg(volume) over {frame(5)}", "bb_width": ratio("400 * sd20", "sma20"), "r2": f"regr_r2(close, rn) over {WC}", "slope": f"regr_slope(close, rn) over {WC}", "body": "abs(close - open)"},
            {"body3": f"avg(body) over {frame(3)}", "least_body3": f"min(body) over {frame(3)}", "ups3": f"sum(case when close > open then 1 else 0 end) over {frame(3)}", "downs3": f"sum(case when close < open then 1 else 0 end) over {frame(3)}"},
        ]
    )
    found = plain.stacked(bars)
    directed = atr_adx().apply(bars).select(*KEY, "atr", "plus_di", "minus_di", "adx")
    aroon = CATALOG["t10_momentum"].apply(bars).select(*KEY, "aroon_up", "aroon_down")
    smooth = recursive_indicators(bars).select(*KEY, "macd", "macd_signal", "macd_hist", "rsi_14")
    for other in (directed, aroon, smooth):
        found = found.join(other, KEY, "left")
    return found


def trend_vote(rows: DataFrame) -> DataFrame:
    """symbol, open_time, up_score, down_score, trend: weighted votes of directional index (.30), means (.25), MACD (.25) and
    relative strength (.20), each by its strength; sideways if they disagree, unknown if they are too weak."""
    c = F.col
    adx_weight = F.when(c("adx") >= 25, 0.30).otherwise(0.30 * c("adx") / 25) * c("adx") / 100
    near = F.least(F.lit(1.0), 10 * F.try_divide(F.abs(c("sma7") - c("sma14")), c("sma14")))
    strong = F.least(F.lit(1.0), 1000 * F.try_divide(F.abs("macd_hist"), c("mean_close")))
    votes = {
        "adx": (adx_weight, c("plus_di") > c("minus_di")),
        "sma": (F.when(((c("close") > c("sma7")) & (c("sma7") > c("sma14"))) | ((c("close") < c("sma7")) & (c("sma7") < c("sma14"))), 0.25 * near).otherwise(0.125 * 0.5 * near), c("close") > c("sma14")),
        "macd": (F.when(c("macd_hist") != 0, 0.25 * strong).otherwise(0.075 * 0.3 * strong), c("macd") > c("macd_signal")),
        "rsi": (F.when((c("rsi_14") > 70) | (c("rsi_14") < 30), 0.14).when((c("rsi_14") > 55) | (c("rsi_14") < 45), 0.10).otherwise(0.0) * F.abs(c("rsi_14") - 50) / 50, c("rsi_14") > 50),
    }
    score = lambda up: sum((F.coalesce(F.when(side == F.lit(up), weight), F.lit(0.0)) for weight, side in votes.values()), F.lit(0.0))
    found = rows.withColumns({"up_score": score(True), "down_score": score(False)})
    up, down = c("up_score"), c("down_score")
    label = F.when((up > down + 0.05) & (up >= 0.15), "uptrend").when((down > up + 0.05) & (down >= 0.15), "downtrend").when(F.greatest(up, down) >= 0.15, "sideways").otherwise("unknown")
    return found.select(*KEY, "up_score", "down_score", label.alias("trend"))


def trend_strength(rows: DataFrame) -> DataFrame:
    """symbol, open_time, strength from 0 to 1: directional index .25, fit of a line .15, Aroon .15, MACD .15, relative
    strength .10, the last three candles .05, calm .10 and volume .05; 0 in the first 19 bars."""
    c = F.col
    clipped = lambda x: F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
    parts = {
        0.25: F.coalesce(clipped(c("adx") / 100), F.lit(0.5)),
        0.15: (F.coalesce("r2", F.lit(0.0)), F.coalesce(F.abs(c("aroon_up") - c("aroon_down")) / 100, F.lit(0.5)), F.coalesce(clipped(100 * F.try_divide(F.abs("macd"), c("mean_close"))), F.lit(0.0))),
        0.10: (
            F.when((c("rsi_14") >= 70) | (c("rsi_14") <= 30), clipped((F.abs(c("rsi_14") - 50) - 20) / 30)).otherwise(0.2),
            F.coalesce(1 - clipped(20 * F.try_divide(c("atr"), c("close"))), F.lit(0.5)),
        ),
        0.05: (
            F.when((c("body3") > 0) & (c("least_body3") > 0.8 * c("body3")) & (((c("slope") > 0) & (c("ups3") == 3)) | ((c("slope") < 0) & (c("downs3") == 3))), 0.2).otherwise(0.0),
            F.coalesce(clipped(F.try_divide(c("volume5"), c("volume20")) / 2), F.lit(0.5)),
        ),
    }
    total = F.lit(0.0)
    for weight, values in parts.items():
        for x in values if isinstance(values, tuple) else (values,):
            total = total + weight * x
    return rows.select(*KEY, F.when(c("rn") < 20, 0.0).otherwise(F.least(F.lit(1.0), total)).alias("strength"))


def market_regime(rows: DataFrame) -> DataFrame:
    """symbol, open_time, regime: one of REGIMES by directional index, volatility against its quartiles over the last hundred
    bars, band width of the last ten against its mean, and relative strength; no data in the first 49 bars."""
    c, hundred, twenty, ten = F.col, _order().rowsBetween(-99, 0), _order().rowsBetween(-19, 0), _order().rowsBetween(-9, 0)
    ready = F.col("adx").isNotNull() & F.col("bb_width").isNotNull() & F.col("rsi_14").isNotNull()
    found = rows.withColumn("nv", F.when(ready, 100 * F.try_divide(c("atr"), c("close")))).withColumn("bw", F.when(ready, c("bb_width")))
    found = found.withColumns(
        {"n": F.count("nv").over(hundred), "q1": F.percentile("nv", 0.25).over(hundred), "q3": F.percentile("nv", 0.75).over(hundred), "recent": F.avg("nv").over(twenty), "width": F.try_divide(F.avg("bw").over(ten), F.avg("bw").over(hundred))}
    )
    up = c("plus_di") > c("minus_di")
    wide, high = c("width") > 1.1, c("recent") > c("q3")
    by_side = lambda a, b: F.when(up, a).otherwise(b)
    strong = F.when(high, by_side(*REGIMES[1:3])).otherwise(by_side(*REGIMES[3:5]))
    moderate = F.when(wide, by_side(*REGIMES[5:7])).otherwise(REGIMES[7])
    tight = F.when((c("rsi_14") > 60) | (c("rsi_14") < 40), REGIMES[8]).otherwise(REGIMES[9])
    weak = F.when(c("width") < 0.9, tight).when(c("recent") < c("q1"), REGIMES[10]).when(wide & high, REGIMES[11]).otherwise(REGIMES[12])
    label = F.when((c("rn") < 50) | ~ready | (c("n") < 20), REGIMES[0]).when(c("adx") > 30, strong).when(c("adx") > 20, moderate).otherwise(weak)
    return found.select(*KEY, label.alias("regime"))


def extremes(rows: DataFrame, column: str, reach: int = 5) -> DataFrame:
    """symbol, rn, open_time, value, side: bars above (1) or below (-1) all of the ``reach`` bars on either side."""
    around = {"before": _order().rowsBetween(-reach, -1), "after": _order().rowsBetween(1, reach)}
    full = F.lit(True)
    for w in around.values():
        full &= F.count(column).over(w) == reach
    x = F.col(column)
    top = full & (x > F.max(column).over(around["before"])) & (x > F.max(column).over(around["after"]))
    low = full & (x < F.min(column).over(around["before"])) & (x < F.min(column).over(around["after"]))
    found = rows.select("symbol", F.row_number().over(_order()).alias("rn"), "open_time", x.alias("value"), F.when(top, 1).when(low, -1).alias("side"))
    return found.where("side is not null")


def divergences(rows: DataFrame, indicator: str, price: str = "close", reach: int = 5, within: int = 3) -> DataFrame:
    """symbol, first_at, second_at, kind: neighbouring extremes of the price whose nearest extremes of the indicator, less
    than ``within`` bars off (the earlier of two as near), move the other way: regular or hidden, bearish at tops, bullish at
    lows. An equi-join on coarse row numbers stands for the join by distance."""
    a, b = extremes(rows, price, reach), extremes(rows, indicator, reach)
    spots = a.withColumn("spot", F.explode(F.sequence(F.col("rn") - within + 1, F.col("rn") + within - 1)))
    near = b.select("symbol", F.col("rn").alias("spot"), "side", F.col("value").alias("other"))
    met = spots.join(near, ["symbol", "spot", "side"]).groupBy("symbol", "rn", "side", "open_time", "value")
    best = met.agg(F.min(F.struct(F.abs(F.col("spot") - F.col("rn")).alias("d"), "spot", "other"))["other"].alias("other"))
    all_tops = a.join(best.select("symbol", "rn", "side", "other"), ["symbol", "rn", "side"], "left")
    w = Window.partitionBy("symbol", "side").orderBy("rn")
    pairs = all_tops.withColumns({"v0": F.lag("value").over(w), "o0": F.lag("other").over(w), "first_at": F.lag("open_time").over(w)})
    up, other_up = F.col("value") > F.col("v0"), F.col("other") > F.col("o0")
    down, other_down = F.col("value") < F.col("v0"), F.col("other") < F.col("o0")
    top = F.col("side") == 1
    kind = F.when(top & up & other_down, "regular_bearish").when(top & down & other_up, "hidden_bearish").when(~top & down & other_up, "regular_bullish").when(~top & up & other_down, "hidden_bullish")
    return pairs.select("symbol", "first_at", F.col("open_time").alias("second_at"), kind.alias("kind")).where("kind is not null")


def price_levels(bars: DataFrame, reach: int = 5, tolerance: float = 0.02, least: int = 3) -> DataFrame:
    """symbol, kind (support or resistance), level, touches: local extremes (ties count) in order of price, in groups that end
    where a price lies more than ``tolerance`` above the group's first one."""
    w = _order().rowsBetween(-reach, reach)
    full = F.count("*").over(w) == 2 * reach + 1
    marked = bars.select("symbol", F.when(full & (F.col("high") == F.max("high").over(w)), F.col("high")).alias("resistance"), F.when(full & (F.col("low") == F.min("low").over(w)), F.col("low")).alias("support"))
    prices = marked.unpivot("symbol", ["resistance", "support"], "kind", "price").where("price is not null")
    lists = prices.groupBy("symbol", "kind").agg(F.array_sort(F.collect_list("price")).alias("prices"))
    nothing = F.array().cast("array<array<double>>")

    def grouped(done: Column, price: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (price <= F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(1)) * (1 + tolerance))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array_append(last, price)))).otherwise(F.array_append(done, F.array(price)))

    groups = lists.select("symbol", "kind", F.explode(F.aggregate("prices", nothing, grouped)).alias("g")).where(F.size("g") >= least)
    return groups.select("symbol", "kind", (F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / F.size("g")).alias("level"), F.size("g").cast("long").alias("touches"))


def breakouts(bars: DataFrame, levels: DataFrame, threshold: float = 0.001) -> DataFrame:
    """symbol, open_time, level, kind (up or down), strength, volume_change: bars whose close crosses a level of their symbol,
    the close before on the other side, by more than ``threshold``. Levels of a symbol are few."""
    rows = bars.withColumns({"before": F.lag("close").over(_order()), "usual": F.avg("volume").over(_order().rowsBetween(-20, -1))})
    both = rows.join(levels.select("symbol", "level"), "symbol")
    up = (F.col("before") < F.col("level")) & (F.col("high") > F.col("level")) & (F.col("close") > F.col("level") * (1 + threshold))
    down = (F.col("before") > F.col("level")) & (F.col("low") < F.col("level")) & (F.col("close") < F.col("level") * (1 - threshold))
    kind = F.when(up, "up").when(down, "down")
    return both.select(*KEY, "level", kind.alias("kind"), F.abs(F.try_divide("close", "level") - 1).alias("strength"), (F.try_divide("volume", "usual") - 1).alias("volume_change")).where("kind is not null")


def trend_summary(bars: DataFrame) -> DataFrame:
    """One row per symbol, at its last bar: trend, strength, regime and a sentence that says them."""
    rows = trend_frame(bars)
    found = trend_vote(rows).join(trend_strength(rows), KEY).join(market_regime(rows), KEY)
    last = found.groupBy("symbol").agg(F.max_by(F.struct("open_time", "trend", "strength", "regime"), "open_time").alias("x")).select("symbol", "x.*")
    weight = F.when(F.col("strength") >= 0.7, "strong").when(F.col("strength") >= 0.4, "moderate").otherwise("weak")
    text = F.concat_ws(" ", F.lit("The"), weight, F.lit("trend is"), F.concat("trend", F.lit(",")), F.lit("the regime"), F.concat(F.regexp_replace("regime", "_", " "), F.lit(".")))
    return last.select("symbol", "open_time", "trend", "strength", "regime", text.alias("summary"))


def trend_sequences(bars: DataFrame, length: int = 30) -> DataFrame:
    """symbol, open_time, closes (the last ``length`` closes scaled to 0..1 by their symbol's range so far), regime_code."""
    low, high = (f.over(_order().rowsBetween(Window.unboundedPreceding, 0)) for f in (F.min("low"), F.max("high")))
    scaled = bars.withColumn("x", F.try_divide(F.col("close") - low, high - low))
    held = scaled.select(*KEY, F.collect_list("x").over(_order().rowsBetween(1 - length, 0)).alias("closes")).where(F.size("closes") == length)
    code = F.array_position(F.array(*map(F.lit, REGIMES)), F.col("regime")) - 1
    return held.join(market_regime(trend_frame(bars)), KEY).select(*KEY, "closes", code.alias("regime_code"))


def projected_turns(bars: DataFrame, reach: int = 10) -> DataFrame:
    """symbol, open_time, kind: bars whose high is above, or low below, all of the ``reach`` bars before them."""
    w = _order().rowsBetween(-reach, -1)
    full = F.count("*").over(w) == reach
    kind = F.when(full & (F.col("high") > F.max("high").over(w)), "top").when(full & (F.col("low") < F.min("low").over(w)), "bottom")
    return bars.select(*KEY, kind.alias("kind")).where("kind is not null")


def chart_patterns(bars: DataFrame, reach: int = 5, alike: float = 0.05, depth: float = 0.02, flat: float = 0.05) -> DataFrame:
    """symbol, kind, start_at, end_at, level, strength of double tops and bottoms and of triangles.

    Two neighbouring swing highs within ``alike`` of their mean, with a swing low between them ``depth`` below the higher one
    (as a share of that low), are a double top; double bottoms the same upside down. A triangle is judged at the end of each symbol, on its last three
    swings of either side (two at least): highs within ``flat`` of their mean over lows that don't fall, or the reverse.
    """
    marked = CATALOG["r01_swings"].stacked(bars).select("symbol", "open_time", "high", "low", "swing_high", "swing_low")
    sides = {"top": marked.where("swing_high = 1").select("symbol", "open_time", F.col("high").alias("price")), "bottom": marked.where("swing_low = 1").select("symbol", "open_time", F.col("low").alias("price"))}
    out = None
    for side, other, sign in (("top", "bottom", 1), ("bottom", "top", -1)):
        pairs = sides[side].withColumns({"next_at": F.lead("open_time").over(_order()), "next_price": F.lead("price").over(_order())})
        near = F.abs(F.col("price") - F.col("next_price")) < alike * (F.col("price") + F.col("next_price")) / 2
        pairs = pairs.where(near).alias("p")
        between = sides[other].select("symbol", F.col("open_time").alias("at"), F.col("price").alias("middle")).alias("m")
        met = pairs.join(between, (F.col("p.symbol") == F.col("m.symbol")) & (F.col("at") > F.col("open_time")) & (F.col("at") < F.col("next_at")))  # swings of a symbol are few
        pick, far = (F.min, F.greatest) if side == "top" else (F.max, F.least)
        each = met.groupBy("p.symbol", "open_time", "next_at", "price", "next_price").agg(pick("middle").alias("middle"))
        outer = far("price", "next_price")
        move = F.try_divide(outer - F.col("middle"), F.col("middle")) if side == "top" else F.try_divide(F.col("middle") - outer, outer)
        one = each.withColumn("move", move).where(F.col("move") > depth)
        one = one.select("symbol", F.lit(f"double_{side}").alias("kind"), F.col("open_time").alias("start_at"), F.col("next_at").alias("end_at"), F.col("middle").alias("level"), F.least(F.lit(1.0), 20 * F.col("move")).alias("strength"))
        out = one if out is None else out.unionByName(one)
    last = {}
    for side, rows in sides.items():
        place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))
        held = rows.withColumn("k", place).where("k <= 3").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("open_time", "price"))).alias(side))
        last[side] = held.where(F.size(side) >= 2)
    both = last["top"].join(last["bottom"], "symbol")
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x["price"]) / F.size(s)
    price = lambda s: F.transform(s, lambda x: x["price"])
    spread = lambda s: (F.array_max(price(s)) - F.array_min(price(s))) / mean(s)
    rising = price("bottom") == F.array_sort(price("bottom"))
    falling = price("top") == F.sort_array(price("top"), False)
    start, end = F.least(F.col("top")[0]["open_time"], F.col("bottom")[0]["open_time"]), F.greatest(F.element_at("top", -1)["open_time"], F.element_at("bottom", -1)["open_time"])
    shapes = {"ascending_triangle": ((spread("top") < flat) & rising, mean("top")), "descending_triangle": ((spread("bottom") < flat) & falling, mean("bottom"))}
    for kind, (holds, level) in shapes.items():
        out = out.unionByName(both.where(holds).select("symbol", F.lit(kind).alias("kind"), start.alias("start_at"), end.alias("end_at"), level.alias("level"), F.lit(0.7).alias("strength")))
    return out


def six_signals(bars: DataFrame) -> DataFrame:
    """symbol, open_time, six signals (1 buy, -1 sell, 0 neither or not known yet), good, bad and their majority.

    Means of 9 and 20 bars, relative strength beyond 30 and 70, MACD against its signal line, stochastic lines under 20 or
    over 80 that have turned, closes outside of the bands, and directional indexes in a trend (25 or more).
    """
    plain = Features([{"sma9": roll("avg", "close", 9), "sma20": roll("avg", "close", 20), "sd20": roll("stddev_samp", "close", 20)}]).stacked(bars)
    rows = plain.join(atr_adx().apply(bars).select(*KEY, "plus_di", "minus_di", "adx"), KEY).join(CATALOG["t06_stochastic"].apply(bars), KEY)
    rows = rows.join(recursive_indicators(bars).select(*KEY, "rsi_14", "macd", "macd_signal"), KEY)
    c = F.col
    sides = {
        "s_means": (c("sma9") > c("sma20"), c("sma9") < c("sma20")), "s_rsi": (c("rsi_14") < 30, c("rsi_14") > 70), "s_macd": (c("macd") > c("macd_signal"), c("macd") < c("macd_signal")),
        "s_stochastic": ((F.greatest("stoch_k", "stoch_d") < 20) & (c("stoch_k") > c("stoch_d")), (F.least("stoch_k", "stoch_d") > 80) & (c("stoch_k") < c("stoch_d"))),
        "s_bands": (c("close") < c("sma20") - 2 * c("sd20"), c("close") > c("sma20") + 2 * c("sd20")), "s_adx": ((c("adx") > 25) & (c("plus_di") > c("minus_di")), (c("adx") > 25) & (c("plus_di") < c("minus_di"))),
    }
    made = rows.select(*KEY, *[F.when(up, 1).when(down, -1).otherwise(0).alias(k) for k, (up, down) in sides.items()])
    count = lambda v: sum((F.when(c(k) == v, 1).otherwise(0) for k in sides), F.lit(0))
    return made.withColumns({"good": count(1), "bad": count(-1)}).withColumn("majority", F.signum(c("good") - c("bad")).cast("int"))
