"""Features, indicators, volatility and trend operators over candles, as staged window plans.

Each entry of CATALOG is one operator: apply() takes candles (symbol, open_time, open, high, low, close, volume) and
returns symbol, open_time and its columns. Rolling values are null until their window is full unless said otherwise.
"""

from __future__ import annotations

from math import log as natural

from candlery.functions.sqlwin import WC, WP, Features, W, frame, lag, lead, log, ratio, roll

RET = f"close / nullif({lag('close')}, 0) - 1"
LOGRET = f"{log('close')} - {log(lag('close'))}"
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
ROWNO = f"row_number() over ({W})"


def _skew(x: str, n: int) -> tuple[str, str]:
    """Bias-corrected sample skewness; null without three values or without spread."""
    f, guard = frame(n), f"count({x}) over {frame(n)} >= 3 and min({x}) over {frame(n)} < max({x}) over {frame(n)}"
    k = f"count({x}) over {f}"
    return (f"case when {guard} then skewness({x}) over {f} * sqrt({k} * ({k} - 1)) / ({k} - 2) end", f"case when {guard} then skewness({x}) over {f} end")


def _kurt(x: str, n: int) -> tuple[str, str]:
    f, guard = frame(n), f"count({x}) over {frame(n)} >= 4 and min({x}) over {frame(n)} < max({x}) over {frame(n)}"
    k = f"count({x}) over {f}"
    fixed = f"(({k} + 1) * kurtosis({x}) over {f} + 6) * ({k} - 1) / (({k} - 2) * ({k} - 3))"
    return (f"case when {guard} then {fixed} end", f"case when {guard} then kurtosis({x}) over {f} end")


def _bool(condition: str) -> str:
    return f"case when {condition} then 1 else 0 end"


def _arg(fn: str, x: str, n: int) -> str:
    """Place (from 0) of the first extreme in the last n rows."""
    return f"case when count({x}) over {frame(n)} >= {n} then array_position(array_agg({x}) over {frame(n)}, {fn}({x}) over {frame(n)}) - 1 end"


def _cyclic(name: str, value: str, period: float) -> dict[str, str]:
    return {f"{name}_sin": f"sin(2 * pi() * ({value}) / {period})", f"{name}_cos": f"cos(2 * pi() * ({value}) / {period})"}


def lagged(columns: tuple[str, ...] = ("close", "volume"), lags: tuple[int, ...] = (1, 3, 5, 7, 14)) -> Features:
    return Features([{f"{c}_lag_{k}": lag(c, k) for c in columns for k in lags}])


def rolling(columns: tuple[str, ...] = ("close",), windows: tuple[int, ...] = (5, 14)) -> Features:
    """Rolling statistics from the first row on (a window may be partly filled)."""
    simple = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum", "var": "var_samp", "median": "q0.5", "q25": "q0.25", "q75": "q0.75"}
    out: dict = {f"{c}_rolling_{n}_{name}": roll(fn, c, n, 1) for c in columns for n in windows for name, fn in simple.items()}
    out |= {f"{c}_rolling_{n}_skew": _skew(c, n) for c in columns for n in windows} | {f"{c}_rolling_{n}_kurt": _kurt(c, n) for c in columns for n in windows}
    return Features([out])


def calendar() -> Features:
    hour, dow, dom, month, doy = "hour(open_time)", "weekday(open_time)", "day(open_time)", "month(open_time)", "dayofyear(open_time)"
    days = "day(last_day(open_time))"
    flags = {
        "is_weekend": _bool(f"{dow} >= 5"), "is_month_start": _bool(f"{dom} = 1"), "is_month_end": _bool(f"{dom} = {days}"),
        "is_quarter_start": _bool(f"{dom} = 1 and {month} in (1, 4, 7, 10)"), "is_quarter_end": _bool(f"{dom} = {days} and {month} in (3, 6, 9, 12)"),
        "is_year_start": _bool(f"{dom} = 1 and {month} = 1"), "is_year_end": _bool(f"{dom} = 31 and {month} = 12"),
        "session_asia": _bool(f"{hour} < 9"), "session_europe": _bool(f"{hour} between 8 and 16"), "session_america": _bool(f"{hour} between 13 and 21"),
        "overlap_asia_europe": _bool(f"{hour} = 8"), "overlap_europe_america": _bool(f"{hour} between 13 and 16"), "inactive_hours": _bool(f"{hour} >= 22"),
    }
    parts = {"hour_n": hour, "dow": dow, "dom": dom, "month_n": month, "quarter_n": "quarter(open_time)", "doy": doy, "week": "weekofyear(open_time)", "year_n": "year(open_time)"}
    parts |= {"time_of_day": f"cast(floor({hour} / 6) as int)", "session_third": f"cast(floor({hour} / 8) as int)"}
    cyclic = _cyclic("hour", hour, 24) | _cyclic("dow", dow, 7) | _cyclic("month", f"{month} - 1", 12) | _cyclic("doy", doy, 366) | _cyclic("week", "weekofyear(open_time)", 52)
    cyclic |= {"dom_sin": f"sin(2 * pi() * ({dom} - 1) / {days})", "dom_cos": f"cos(2 * pi() * ({dom} - 1) / {days})"}
    return Features([parts | flags | cyclic], whole={*parts, *flags})


def returns(periods: tuple[int, ...] = (1, 3, 7)) -> Features:
    first = {}
    for p in periods:
        first |= {
            f"return_{p}p": f"close / nullif({lag('close', p)}, 0) - 1",
            f"log_return_{p}p": f"{log('close')} - {log(lag('close', p))}",
            f"abs_change_{p}p": f"close - {lag('close', p)}",
            f"direction_{p}p": f"sign(close - {lag('close', p)})",
        }
    n = lambda p: max(2, p * 5)
    r = lambda p: f"return_{p}p"
    second = {f"z_score_return_{p}p": ratio(f"{r(p)} - {roll('avg', r(p), n(p), n(p) // 2)}", roll("stddev_samp", r(p), n(p), n(p) // 2)) for p in periods}
    return Features([first, second], whole={f"direction_{p}p" for p in periods})


def volumes(windows: tuple[int, ...] = (5, 10, 20)) -> Features:
    first = {f"volume_ma_{n}": roll("avg", "volume", n, 1) for n in windows}
    first |= {"volume_change": f"volume - {lag('volume')}", "volume_pct_change": ratio(f"volume - {lag('volume')}", lag("volume"))}
    first["volume_day_sum"] = "sum(volume) over (partition by symbol, date_trunc('day', open_time) order by open_time rows between unbounded preceding and current row)"
    second = {f"volume_rel_{n}": ratio("volume", f"volume_ma_{n}") for n in windows}
    second |= {f"volume_z_{n}": ratio(f"volume - {roll('avg', 'volume', n)}", roll("stddev_samp", "volume", n)) for n in windows}
    second |= {f"volume_ma_change_{n}": ratio(f"volume_ma_{n} - {lag(f'volume_ma_{n}')}", lag(f"volume_ma_{n}")) for n in windows}
    third = {"volume_anomaly": _bool(f"volume_rel_{windows[-1]} > 2")}
    return Features([first, second, third], whole={"volume_anomaly"})


def targets(horizon: int = 3) -> Features:
    """Values ahead of each bar; the last bars have none."""
    ahead = f"({W} rows between 1 following and {horizon} following)"
    future = lead("close", horizon)
    first = {
        "target_return": f"{future} / nullif(close, 0) - 1",
        "target_log_return": f"{log(future)} - {log('close')}",
        "target_direction": f"case when {future} is not null then case when {future} > close then 1 else 0 end end",
        "target_price": future,
        "target_range": ratio(f"case when {future} is not null then max(high) over {ahead} - min(low) over {ahead} end", "close"),
        "target_close_1": lead("close", 1), "target_close_5": lead("close", 5), "target_close_10": lead("close", 10), "step_return": RET,
    }
    second = {"target_volatility": f"case when {lead('step_return', horizon)} is not null then stddev_samp(step_return) over {ahead} end"}
    return Features([first, second], whole={"target_direction"})


def ratios(clip: float = 0.01) -> Features:
    """Ratios with a zero denominator replaced by the symbol's median ratio, clipped to outer percentiles."""
    pairs = {"high_low": ("high", "low"), "close_open": ("close", "open"), "volume_close": ("volume", "close")}
    one = {f"{k}_raw": ratio(a, b) for k, (a, b) in pairs.items()}
    stats = {}
    for k in pairs:
        stats |= {f"{k}_{s}": f"percentile({k}_raw, {p}) over {WP}" for s, p in (("mid", 0.5), ("lo", clip), ("hi", 1 - clip))}
    last = {f"ratio_{k}": f"least(greatest(coalesce({k}_raw, {k}_mid), {k}_lo), {k}_hi)" for k in pairs}
    return Features([one, stats, last], hidden={*one, *stats})


def crossover(fast: int = 5, slow: int = 20, slope: int = 3) -> Features:
    one = {"fast": roll("avg", "close", fast), "slow": roll("avg", "close", slow), "rn": ROWNO}
    two = {"diff": "fast - slow", "rel_diff": ratio("100.0 * (fast - slow)", "slow"), "state": "sign(fast - slow)"}
    three = {
        "golden_cross": _bool(f"diff > 0 and {lag('diff')} <= 0"),
        "death_cross": _bool(f"diff < 0 and {lag('diff')} >= 0"),
        "slope_diff": f"(fast - {lag('fast', slope)}) - (slow - {lag('slow', slope)})",
    }
    four = {"cross_rn": "case when golden_cross = 1 or death_cross = 1 then rn end"}
    five = {"bars_since_cross": f"rn - coalesce(last_value(cross_rn) ignore nulls over {WC}, 1)"}
    return Features([one, two, three, four, five], whole={"state", "golden_cross", "death_cross", "bars_since_cross"}, hidden={"rn", "cross_rn"})


def microstructure() -> Features:
    one = {
        "range_pct": ratio("high - low", "low"), "volume_per_range": ratio("volume", f"nullif({ratio('high - low', 'low')}, 0)"),
        "zero_volume": _bool("volume = 0"), "flat_candle": _bool("high = low"), "price_change_pct": ratio("100.0 * (close - open)", "open"),
        "body_pct": ratio("abs(close - open)", "high - low"), "upper_shadow_pct": ratio("high - greatest(open, close)", "high - low"),
        "lower_shadow_pct": ratio("least(open, close) - low", "high - low"), "is_doji": _bool(f"{ratio('abs(close - open)', 'open')} < 0.0005"),
        "volume_ma_24": roll("avg", "volume", 24, 1),
    }
    return Features([one, {"volume_spike": _bool("volume > 3 * volume_ma_24")}], whole={"zero_volume", "flat_candle", "is_doji", "volume_spike"})


def sma() -> Features:
    return Features([{f"sma_{n}": roll("avg", "close", n) for n in (5, 9, 10, 20, 50, 200)}])


def rsi_simple(n: int = 14) -> Features:
    """Relative strength from plain means of gains and losses."""
    one = {"gain": f"greatest(close - {lag('close')}, 0)", "loss": f"greatest({lag('close')} - close, 0)"}
    one = {k: f"case when {lag('close')} is not null then {v} end" for k, v in one.items()}
    two = {"up": roll("avg", "gain", n), "down": roll("avg", "loss", n)}
    return Features([one, two, {f"rsi_{n}": ratio("100.0 * up", "up + down")}], hidden={"gain", "loss", "up", "down"})


def bollinger(n: int = 20, k: float = 2.0) -> Features:
    one = {"bb_middle": roll("avg", "close", n), "bb_sd": roll("stddev_samp", "close", n)}
    two = {"bb_upper": f"bb_middle + {k} * bb_sd", "bb_lower": f"bb_middle - {k} * bb_sd"}
    return Features([one, two, {"bb_width": ratio("bb_upper - bb_lower", "bb_middle"), "bb_percent": ratio("close - bb_lower", "bb_upper - bb_lower")}], hidden={"bb_sd"})


def stochastic(n: int = 14) -> Features:
    raw = ratio(f"100.0 * (close - min(low) over {frame(n)})", f"(max(high) over {frame(n)} - min(low) over {frame(n)})")
    one = {"raw_k": f"case when count(close) over {frame(n)} >= {n} then {raw} end"}
    return Features([one, {"stoch_k": roll("avg", "raw_k", 3)}, {"stoch_d": roll("avg", "stoch_k", 3)}], hidden={"raw_k"})


def atr_adx(n: int = 14) -> Features:
    """Average true range and directional index from plain means."""
    up, down = f"high - {lag('high')}", f"{lag('low')} - low"
    one = {"tr": TR, "up_move": up, "down_move": down}
    two = {"atr": roll("avg", "tr", n), "pdm": "case when up_move > down_move and up_move > 0 then up_move when up_move is not null then 0 end",
           "mdm": "case when down_move > up_move and down_move > 0 then down_move when down_move is not null then 0 end"}
    three = {"plus_di": ratio(f"100.0 * {roll('avg', 'pdm', n)}", "atr"), "minus_di": ratio(f"100.0 * {roll('avg', 'mdm', n)}", "atr")}
    four = {"dx": ratio("100.0 * abs(plus_di - minus_di)", "plus_di + minus_di")}
    return Features([one, two, three, four, {"adx": roll("avg", "dx", n)}], hidden={"up_move", "down_move", "pdm", "mdm", "dx"})


def volume_indicators() -> Features:
    one = {"signed": f"coalesce(sign(close - {lag('close')}), 0) * volume", "tp": "(high + low + close) / 3", "clv": f"coalesce({ratio('(close - low) - (high - close)', 'high - low')}, 0)"}
    two = {"obv": f"sum(signed) over {WC}", "volume_delta": "signed", "accumulation": f"sum(clv * volume) over {WC}"}
    two |= {f"vwap_{n}": f"case when count(close) over {frame(n)} >= {n} then sum(tp * volume) over {frame(n)} / nullif(sum(volume) over {frame(n)}, 0) end" for n in (14, 30)}
    day = "(partition by symbol, date_trunc('day', open_time) order by open_time rows between unbounded preceding and current row)"
    two["vwap_session"] = f"sum(tp * volume) over {day} / nullif(sum(volume) over {day}, 0)"
    return Features([one, two], hidden={"signed", "tp", "clv"})


def momentum() -> Features:
    one = {f"roc_{n}": ratio(f"100.0 * (close - {lag('close', n)})", lag("close", n)) for n in (5, 10, 20)}
    one |= {"tp": "(high + low + close) / 3", "up_at": _arg("max", "high", 15), "down_at": _arg("min", "low", 15)}
    two = {"tp_mean": roll("avg", "tp", 20), "tp_list": f"array_agg(tp) over {frame(20)}", "aroon_up": "100.0 * up_at / 14", "aroon_down": "100.0 * down_at / 14"}
    mad = ("aggregate(tp_list, cast(0 as double), (s, x) -> s + abs(x - tp_mean)) / 20", "list_sum(list_transform(tp_list, lambda x: abs(x - tp_mean))) / 20")
    return Features([one, two, {"tp_mad": mad}, {"cci_20": ratio("tp - tp_mean", "0.015 * tp_mad")}], hidden={"tp", "up_at", "down_at", "tp_mean", "tp_list", "tp_mad"})


def ichimoku() -> Features:
    mid = lambda n: f"case when count(close) over {frame(n)} >= {n} then (max(high) over {frame(n)} + min(low) over {frame(n)}) / 2 end"
    one = {"tenkan": mid(9), "kijun": mid(26), "senkou_b_now": mid(52), "chikou_future": lead("close", 26)}
    two = {"senkou_a": lag("(tenkan + kijun) / 2", 26), "senkou_b": lag("senkou_b_now", 26)}
    return Features([one, two], hidden={"senkou_b_now"})


def custom() -> Features:
    around = lambda n: f"({W} rows between {n // 2} preceding and {n - 1 - n // 2} following)"
    one: dict = {}
    for n in (21, 34):
        full = f"count(close) over {around(n)} >= {n}"
        one |= {f"local_max_{n}": _bool(f"{full} and close = max(close) over {around(n)}"), f"local_min_{n}": _bool(f"{full} and close = min(close) over {around(n)}")}
    five = f"({W} rows between 2 preceding and 2 following)"
    inner = f"count(close) over {five} >= 5"
    one |= {
        "fractal_high": _bool(f"{inner} and close = max(close) over {five} and close <> {lag('close', 2)} and close <> {lead('close', 2)}"),
        "fractal_low": _bool(f"{inner} and close = min(close) over {five} and close <> {lag('close', 2)} and close <> {lead('close', 2)}"),
    }
    whole = set(one)
    for n in (55, 89):
        top, bottom = f"max(close) over {frame(n)}", f"min(close) over {frame(n)}"
        for level in (0.236, 0.382, 0.5, 0.618, 0.786):
            at = f"({bottom} + {level} * ({top} - {bottom}))"
            name = f"near_fib_{str(level).replace('.', '_')}_{n}"
            one[name] = _bool(f"count(close) over {frame(n)} >= {n} and abs(close - {at}) < 0.005 * close")
            whole.add(name)
    one |= {"daily_range_ratio": f"abs({ratio(f'close - {lag("close", 24)}', lag('close', 24))})", "sign_move": f"sign(close - {lag('close')})", "volume_price_ratio": ratio("volume", "close")}
    one["cycle_position_90"] = f"({_arg('max', 'close', 90)}) / 89.0"
    for n in (14, 21):
        one[f"consolidation_{n}"] = ratio(roll("avg", "(high - low)", n), f"(max(high) over {frame(n)} - min(low) over {frame(n)})")
    two = {f"trend_strength_{n}": f"abs({roll('sum', 'sign_move', n)}) / {n}.0" for n in (7, 14, 30)}
    return Features([one, two], whole=whole, hidden={"sign_move"})


def candle_patterns(tolerance: float = 0.001) -> Features:
    """Body, shadows and candle patterns of one, two and three bars as 0/1 columns; a pattern whose bars aren't all there is 0."""
    one = {"body": "abs(close - open)", "rng": "high - low", "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low", "direction": "sign(close - open)"}
    two = {"rel_body": ratio("body", "rng"), "body_ma": roll("avg", "body", 20), "rng_ma": roll("avg", "rng", 20), "low5": roll("min", "low", 5), "high5": roll("max", "high", 5)}
    three = {f"{c}_1": lag(c) for c in ("open", "close", "high", "low", "body", "direction", "rel_body", "low5", "high5")} | {f"{c}_2": lag(c, 2) for c in ("open", "close", "direction")} | {"rel_candle": ratio("rng", "rng_ma")}
    same = lambda a, b, c: f"abs({a} - {b}) < {tolerance} * {c}"
    flags = {
        "doji": "rel_body < 0.1", "hammer": "rel_body < 0.3 and lower_shadow > 2 * body and upper_shadow < 0.2 * lower_shadow",
        "inverted_hammer": "rel_body < 0.3 and upper_shadow > 2 * body and lower_shadow < 0.2 * upper_shadow", "long_candle": "body > 1.5 * body_ma",
        "marubozu": "upper_shadow < 0.05 * rng and lower_shadow < 0.05 * rng and rel_body > 0.9", "high_wave": "rel_body < 0.3 and (upper_shadow > 3 * body or lower_shadow > 3 * body)",
        "firefly": "rel_body < 0.25 and upper_shadow < 0.1 * rng and lower_shadow > 2.5 * body",
        "bullish_engulfing": "direction_1 = -1 and direction = 1 and open < close_1 and close > open_1", "bearish_engulfing": "direction_1 = 1 and direction = -1 and open > close_1 and close < open_1",
        "morning_star": "direction_2 = -1 and rel_body_1 < 0.3 and direction = 1 and close > (open_2 + close_2) / 2", "evening_star": "direction_2 = 1 and rel_body_1 < 0.3 and direction = -1 and close < (open_2 + close_2) / 2",
        "three_white_soldiers": "direction_2 = 1 and direction_1 = 1 and direction = 1 and close_1 > close_2 and close > close_1",
        "three_black_crows": "direction_2 = -1 and direction_1 = -1 and direction = -1 and close_1 < close_2 and close < close_1",
        "doji_star": "rel_body < 0.1 and low_1 is not null and coalesce(rel_body_1, 1) >= 0.1", "top_pinbar": f"{same('high', 'high_1', 'high')} and direction_1 <> direction", "bottom_pinbar": f"{same('low', 'low_1', 'low')} and direction_1 <> direction",
        "bullish_harami": "direction_1 = -1 and direction = 1 and open > close_1 and close < open_1 and body < 0.6 * body_1", "bearish_harami": "direction_1 = 1 and direction = -1 and open < close_1 and close > open_1 and body < 0.6 * body_1",
        "ascending_triangle": f"low > low5_1 and {same('high', 'high5_1', 'high')}", "descending_triangle": f"high < high5_1 and {same('low', 'low5_1', 'low')}",
    }
    hidden = {"body_ma", "rng_ma", "low5", "high5", *three} - {"rel_candle"}
    return Features([one, two, three, {k: _bool(v) for k, v in flags.items()}], whole={*flags, "direction"}, hidden=hidden)


def volatility(windows: tuple[int, ...] = (14, 30), year: int = 365, gaps: bool = False) -> Features:
    """Close-to-close, Parkinson, Garman-Klass and Yang-Zhang estimators, annualised, and breakouts of the first.

    With ``gaps`` a bar without a range (a price of 0) is left out of the means of a full window, which has no value else;
    and Garman-Klass, else 0 where its mean isn't known, is null there.
    """
    co, hl = log(ratio("close", "open")), log(ratio("high", "low"))
    one = {
        "lr": LOGRET, "pk": f"power({hl}, 2) / {4 * natural(2)}", "gk": f"0.5 * power({hl}, 2) - {2 * natural(2) - 1} * power({co}, 2)",
        "overnight": f"{log('open')} - {log(lag('close'))}", "oc": co, "rs": f"{log(ratio('high', 'close'))} * {log(ratio('high', 'open'))} + {log(ratio('low', 'close'))} * {log(ratio('low', 'open'))}",
    }
    over = (lambda fn, x, n: f"case when count(*) over {frame(n)} = {n} then {fn}({x}) over {frame(n)} end") if gaps else roll
    two = {}
    for n in windows:
        gk = over("avg", "gk", n)
        two |= {
            f"hist_vol_{n}": f"{roll('stddev_samp', 'lr', n)} * sqrt({year})",
            f"parkinson_{n}": f"sqrt({over('avg', 'pk', n)} * {year})",
            f"garman_klass_{n}": f"sqrt((case when {gk} < 0 then 0 else {gk} end) * {year})" if gaps else f"sqrt(greatest({gk}, 0) * {year})",
            f"yang_zhang_{n}": f"sqrt(({roll('var_samp', 'overnight', n)} + 0.34 * {over('var_samp', 'oc', n)} + 0.66 * {over('avg', 'rs', n)}) * {year})",
        }
    n = windows[0]
    three = {f"vol_mean_{n}": roll("avg", f"hist_vol_{n}", 20), f"vol_sd_{n}": roll("stddev_samp", f"hist_vol_{n}", 20), "vol_of_vol": roll("stddev_samp", f"hist_vol_{n}", n), "rel_vol": ratio(f"hist_vol_{n}", f"hist_vol_{windows[-1]}")}
    return Features([one, two, three, {"vol_breakout": _bool(f"hist_vol_{n} > vol_mean_{n} + 2 * vol_sd_{n}")}], whole={"vol_breakout"}, hidden={*one, f"vol_mean_{n}", f"vol_sd_{n}"})


def volatility_features(windows: tuple[int, ...] = (7, 14)) -> Features:
    """The feature-set variants: annualised over 252 periods from half a window on."""
    one = {"lr": LOGRET, "hl": f"power({log(ratio('high', 'low'))}, 2)", "co": f"power({log(ratio('close', 'open'))}, 2)", "ov": f"{log('open')} - {log(lag('close'))}", "oc": log(ratio("close", "open"))}
    two = {}
    for n in windows:
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        h = n // 2
        two |= {
            f"f_hist_{n}": f"{roll('stddev_samp', 'lr', n, h)} * sqrt(252)",
            f"f_realized_{n}": f"sqrt({roll('sum', 'lr * lr', n, h)})",
            f"f_parkinson_{n}": f"sqrt({roll('avg', 'hl', n, h)} / {4 * natural(2)} * 252)",
            f"f_gk_{n}": f"sqrt(greatest(0.5 * {roll('avg', 'hl', n, h)} - {2 * natural(2) - 1} * {roll('avg', 'co', n, h)}, 0) * 252)",
            f"f_yz_{n}": f"sqrt(({roll('var_samp', 'ov', n, max(h, 2))} + {k} * {roll('var_samp', 'oc', n, max(h, 2))}) * 252)",
        }
    a, b = windows[0], windows[-1]
    return Features([one, two, {"f_relative": ratio(f"f_hist_{a}", f"f_hist_{b}")}], hidden=set(one))


def swings(k: int = 5) -> Features:
    before, after = f"({W} rows between {k} preceding and 1 preceding)", f"({W} rows between 1 following and {k} following)"
    full = f"count(close) over {before} = {k} and count(close) over {after} = {k}"
    one = {
        "swing_high": _bool(f"{full} and high > max(high) over {before} and high > max(high) over {after}"),
        "swing_low": _bool(f"{full} and low < min(low) over {before} and low < min(low) over {after}"),
        "high_strength": ratio(f"high - greatest(max(high) over {before}, max(high) over {after})", "high"),
    }
    return Features([one], whole={"swing_high", "swing_low"}, where="swing_high = 1 or swing_low = 1")


def market_phase(n: int = 30) -> Features:
    """accumulation 1, uptrend 2, distribution 3, downtrend 4, 0 none of them; of several that hold the later rule wins.

    Short and long mean, momentum, volume against its mean, volatility against its own mean, and plain relative strength
    with a first move of nothing.
    """
    one = {"fast": roll("avg", "close", n // 3), "slow": roll("avg", "close", n), "volume_mean": roll("avg", "volume", n // 2), "cv": ratio(roll("stddev_samp", "close", n // 2), "close"),
           "momentum": ratio(f"close - {lag('close', n // 4)}", lag("close", n // 4)), "gain": f"greatest(coalesce(close - {lag('close')}, 0), 0)", "loss": f"greatest(coalesce({lag('close')} - close, 0), 0)"}
    two = {"up": roll("avg", "gain", 14), "down": roll("avg", "loss", 14), "cv_mean": roll("avg", "cv", 2 * n)}
    three = {"rsi": "100 - 100 / (1 + up / case when down = 0 then 0.00001 else down end)"}
    calm = "momentum > -0.05 and momentum < 0.05 and cv < cv_mean"
    rules = f"case when fast < slow and momentum < 0 then 4 when fast > slow and {calm} and rsi > 50 then 3 when fast > slow and momentum > 0 and volume > volume_mean then 2 when fast < slow and {calm} and rsi < 50 then 1 else 0 end"
    return Features([one, two, three, {"phase": rules}], whole={"phase"}, hidden={*one, *two, "rsi"})


def bull_bear(move: float = 0.2, least_days: int = 20) -> Features:
    """kept is 1 in cycles that last ``least_days`` from their first bar to their last one. Two-state automaton: a rise of ``move`` off the lowest close so far sets bull, a fall off the highest bear; both
    toggle. The state is the last bar that set it, turned round by the toggles since."""
    one = {"rise": ratio(f"close - min(close) over {WC}", f"(min(close) over {WC})"), "fall": ratio(f"close - max(close) over {WC}", f"(max(close) over {WC})"), "rn": ROWNO}
    two = {"bull": _bool(f"rise >= {move}"), "bear": _bool(f"fall <= -{move}")}
    three = {"started": f"max(bull) over {WC}", "set_to": "case when bull = 1 and bear = 0 then 1 when bear = 1 and bull = 0 then 0 end", "toggle": "bull * bear"}
    four = {"first_bull": f"min(case when bull = 1 then rn end) over {WP}"}
    five = {"event": "case when rn = first_bull then 1 when rn > first_bull then set_to end", "flip": "case when rn > first_bull and toggle = 1 then 1 else 0 end"}
    six = {"base": f"last_value(event) ignore nulls over {WC}", "event_rn": f"max(case when event is not null then rn end) over {WC}", "flips": f"sum(flip) over {WC}"}
    seven = {"flips_at": f"max(case when event is not null and rn = event_rn then flips end) over {WC}"}
    eight = {"is_bull": "case when started = 1 then case when cast(flips - flips_at as bigint) % 2 = 0 then base else 1 - base end end"}
    nine = f"case when is_bull is not null and coalesce({lag('is_bull')}, -1) <> is_bull then 1 else 0 end"
    hidden = {*two, *three, *four, *five, *six, *seven, "rn"}
    cycle = "(partition by symbol, cycle_no)"
    return Features([one, two, three, four, five, six, seven, eight, {"cycle_start": nine}, {"cycle_no": f"sum(cycle_start) over {WC}"}, {"kept": _bool(f"is_bull is not null and days_between(min(open_time) over {cycle}, max(open_time) over {cycle}) >= {least_days}")}], whole={"is_bull", "cycle_start", "cycle_no", "kept"}, hidden=hidden)


def stationary(season: int = 6) -> Features:
    one = {"diff": f"close - {lag('close')}", "log_close": log("close"), "pct": RET, "seasonal": f"close - {lag('close', season)}", "high_low_range": "high - low", "open_close": "close - open"}
    two = {"diff2": f"diff - {lag('diff')}", "log_diff": f"log_close - {lag('log_close')}", "combo": f"seasonal - {lag('seasonal')}"}
    return Features([one, two])


def robust_outliers(limit: float = 5.0) -> Features:
    """Deviations from the symbol's median over 1.4826 MAD, and outside of ten to ninety percent ranges."""
    one = {f"med_{c}": f"percentile({c}, 0.5) over {WP}" for c in ("close", "volume")} | {f"{c}_{s}": f"percentile({c}, {p}) over {WP}" for c in ("close", "volume") for s, p in (("p10", 0.1), ("p90", 0.9))}
    two = {f"dev_{c}": f"abs({c} - med_{c})" for c in ("close", "volume")}
    three = {f"mad_{c}": f"percentile(dev_{c}, 0.5) over {WP}" for c in ("close", "volume")}
    four = {f"z_{c}": ratio(f"dev_{c}", f"1.4826 * mad_{c}") for c in ("close", "volume")}
    five = {f"anomaly_z_{c}": _bool(f"z_{c} > {limit}") for c in ("close", "volume")}
    # a range of nothing is replaced by eight of the least deviations from the median, around the median
    near = {c: f"abs({c}_p90 - {c}_p10) <= 1e-8 + 1e-5 * abs({c}_p90)" for c in ("close", "volume")}
    for c in ("close", "volume"):
        reach = f"{limit} * 8 * (min(case when dev_{c} > 0 then dev_{c} end) over {WP})"
        five[f"anomaly_iqr_{c}"] = _bool(f"case when {near[c]} then dev_{c} > {reach} else {c} > {c}_p90 + {limit} * ({c}_p90 - {c}_p10) or {c} < {c}_p10 - {limit} * ({c}_p90 - {c}_p10) end")
    six = {"is_anomaly": _bool(" or ".join(f"{k} = 1" for k in five))}
    return Features([one, two, three, four, five, six], whole={*five, "is_anomaly"}, hidden={*one, *two, *three})


def domain_rules(step: int = 14_400) -> Features:
    one = {"pct": RET, "amplitude": "case when high + low > 0 then (high - low) / (0.5 * (high + low)) end", "gap_s": f"seconds_between({lag('open_time')}, open_time)", "med24": f"percentile(nullif(volume, 0), 0.5) over {frame(24)}"}
    two = {"amp95": f"percentile(amplitude, 0.95) over {WP}"}
    flags = {
        "anomaly_jump": "abs(pct) > 0.15", "anomaly_price": "close <= 0 or open <= 0 or high <= 0 or low <= 0", "anomaly_ohlc": "high < low or close > high or close < low or open > high or open < low",
        "anomaly_zero_volume": "volume = 0", "anomaly_negative_volume": "volume < 0", "anomaly_volume": "volume > 20 * med24", "anomaly_flash": "amplitude > 3 * amp95",
        "anomaly_reversal": f"amplitude > 2 * amp95 and ({ratio('high - close', 'high')} < 0.01 or {ratio('close - low', 'close')} < 0.01)", "anomaly_gap": f"gap_s > {3 * step}",
    }
    return Features([one, two, {k: _bool(v) for k, v in flags.items()}], whole=set(flags), hidden={"amplitude", "gap_s", "med24", "amp95"})


def repaired(k: float = 3.0) -> Features:
    """Inverted highs and lows swapped, negatives replaced by medians, far outliers (k times the quartile range) emptied
    and filled along time, the envelope of high and low restored."""
    one = {"hi": "greatest(high, low)", "lo": "least(high, low)", "q1": f"percentile(close, 0.25) over {WP}", "q3": f"percentile(close, 0.75) over {WP}", "med": f"percentile(close, 0.5) over {WP}", "vmed": f"percentile(volume, 0.5) over {WP}", "swapped": _bool("high < low")}
    one["at_s"] = ("cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', open_time) as double)", "cast(epoch(open_time) as double)")
    two = {"kept": f"case when close < 0 then med when close > q3 + {k} * (q3 - q1) or close < greatest(q1 - {k} * (q3 - q1), 0) then null else close end", "volume_clean": "case when volume < 0 then vmed else volume end"}
    back = f"({W} desc rows between unbounded preceding and current row)"
    three = {"v0": f"last_value(kept) ignore nulls over {WC}", "v1": f"last_value(kept) ignore nulls over {back}", "kt": "case when kept is not null then at_s end"}
    four = {"t0": f"last_value(kt) ignore nulls over {WC}", "t1": f"last_value(kt) ignore nulls over {back}"}
    five = {"close_clean": "coalesce(kept, case when v0 is not null and v1 is not null and t1 > t0 then v0 + (v1 - v0) * (at_s - t0) / (t1 - t0) end, v0, v1)", "was_outlier": _bool("kept is null and close is not null")}
    six = {"high_clean": "greatest(hi, open, close_clean)", "low_clean": "least(lo, open, close_clean)"}
    return Features([one, two, three, four, five, six], whole={"swapped", "was_outlier"}, hidden={"hi", "lo", "q1", "q3", "med", "vmed", "at_s", "kept", *three, *four})


def normalized() -> Features:
    """z-score, min-max to 0.01..1 and robust scaling of close per symbol, and min-max of volume."""
    one = {"mu": f"avg(close) over {WP}", "sd": f"stddev_pop(close) over {WP}", "mn": f"min(close) over {WP}", "mx": f"max(close) over {WP}", "q1": f"percentile(close, 0.25) over {WP}", "q2": f"percentile(close, 0.5) over {WP}", "q3": f"percentile(close, 0.75) over {WP}", "vmn": f"min(volume) over {WP}", "vmx": f"max(volume) over {WP}"}
    two = {"close_z": ratio("close - mu", "sd"), "close_minmax": f"0.01 + 0.99 * {ratio('close - mn', 'mx - mn')}", "close_robust": ratio("close - q2", "q3 - q1"), "volume_minmax": ratio("volume - vmn", "vmx - vmn")}
    two |= {"close_back": f"mn + ((0.01 + 0.99 * {ratio('close - mn', 'mx - mn')}) - 0.01) / 0.99 * (mx - mn)"}
    return Features([one, two], hidden=set(one))


def trend_signals() -> Features:
    """Signals of moving averages, bands and relative strength, their majority, and the trend regime."""
    one = {"sma20": roll("avg", "close", 20), "sma50": roll("avg", "close", 50), "sd20": roll("stddev_samp", "close", 20), "g": f"greatest(close - {lag('close')}, 0)", "l": f"greatest({lag('close')} - close, 0)"}
    two = {"rsi": ratio(f"100.0 * {roll('avg', 'g', 14)}", f"({roll('avg', 'g', 14)} + {roll('avg', 'l', 14)})")}
    three = {"s_cross": "sign(sma20 - sma50)", "s_price": "sign(close - sma20)", "s_rsi": "case when rsi < 30 then 1 when rsi > 70 then -1 else 0 end", "s_band": "case when close < sma20 - 2 * sd20 then 1 when close > sma20 + 2 * sd20 then -1 else 0 end"}
    four = {"votes": "coalesce(s_cross, 0) + coalesce(s_price, 0) + s_rsi + s_band"}
    five = {"signal": "sign(votes)", "strength": "votes / 4.0", "sma_cross": _bool(f"s_cross <> {lag('s_cross')}")}
    return Features([one, two, three, four, five], whole={"s_cross", "s_price", "s_rsi", "s_band", "votes", "signal", "sma_cross"}, hidden={"sd20", "g", "l"})


#: Operator name -> its plan. Names begin with the group of the inventory they belong to.
CATALOG: dict[str, Features] = {
    "w01_lagged": lagged(), "w02_rolling": rolling(), "w04_calendar": calendar(), "w08_returns": returns(), "w09_volumes": volumes(), "w10_targets": targets(),
    "w11_ratios": ratios(), "w12_crossover": crossover(), "w14_microstructure": microstructure(), "t01_sma": sma(), "t03_rsi_simple": rsi_simple(),
    "t05_bollinger": bollinger(), "t06_stochastic": stochastic(), "t07_atr_adx": atr_adx(), "t09_volume_indicators": volume_indicators(), "t10_momentum": momentum(),
    "t16_ichimoku": ichimoku(), "c01_custom": custom(), "k01_candle_patterns": candle_patterns(), "v01_volatility": volatility(), "v05_volatility_features": volatility_features(),
    "r01_swings": swings(), "y04_market_phase": market_phase(), "y05_bull_bear": bull_bear(), "g05_stationary": stationary(), "o02_robust_outliers": robust_outliers(),
    "o05_domain_rules": domain_rules(), "f05_repaired": repaired(), "m03_normalized": normalized(), "z02_trend_signals": trend_signals(),
}
