"""Indicators that carry state from bar to bar: exponential averages, Wilder smoothing, SuperTrend, parabolic SAR.

Kernels are plain numpy loops over one symbol's bars, run by applyInPandas. A group holds bars, not ticks, so the
calendar bounds it. The streaming operators use the same kernels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BARS = "symbol string, open_time timestamp_ntz"


def ewm_mean(x: np.ndarray, alpha: float, adjust: bool = False) -> np.ndarray:
    """Exponentially weighted mean; null values keep the last one and let weights age."""
    out, total, weight, value = np.full(len(x), np.nan), 0.0, 0.0, np.nan
    for i, v in enumerate(x):
        if adjust:
            total, weight = total * (1 - alpha), weight * (1 - alpha)
            if v == v:
                total, weight = total + v, weight + 1
            value = total / weight if weight else np.nan
        elif v == v:
            value = v if value != value else (1 - alpha) * value + alpha * v
        out[i] = value
    return out


def ewm_moments(x: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponentially weighted mean and bias-corrected variance over all values so far (weights fall by 1 - 2 / (span + 1))."""
    keep, mean, var = 1 - 2 / (span + 1), np.full(len(x), np.nan), np.full(len(x), np.nan)
    w = w2 = m = spread = 0.0  # sums of weights and of their squares, weighted mean, weighted sum of squared deviations
    for i, v in enumerate(x):
        w, w2, spread = w * keep, w2 * keep * keep, spread * keep
        if v == v:
            w, w2 = w + 1, w2 + 1
            step = v - m
            m += step / w
            spread += step * (v - m)
        mean[i] = m if w else np.nan
        var[i] = spread / w * (w * w / (w * w - w2)) if w * w - w2 > 1e-12 else np.nan
    return mean, var


def seeded_ema(x: np.ndarray, n: int, alpha: float | None = None) -> np.ndarray:
    """Exponential mean that starts from the plain mean of the first n values; null before. Leading nulls are skipped."""
    out, alpha = np.full(len(x), np.nan), alpha or 2 / (n + 1)
    known = np.flatnonzero(~np.isnan(x))
    if len(known) < n:
        return out
    first = known[0] + n - 1
    if first >= len(x):
        return out
    value = x[known[0] : first + 1].mean()
    out[first] = value
    for i in range(first + 1, len(x)):
        value += alpha * (x[i] - value) if x[i] == x[i] else 0.0
        out[i] = value
    return out


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return seeded_ema(x, n, 1 / n)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def rsi(close: np.ndarray, n: int) -> np.ndarray:
    step = np.diff(close, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(step), np.nan, np.fmax(step, 0)), n), wilder(np.where(np.isnan(step), np.nan, np.fmax(-step, 0)), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(up + down == 0, np.nan, 100 * up / (up + down))


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 10, k: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """The trailing band and its side (1 below a rising price, -1 above a falling one)."""
    atr, middle = wilder(true_range(high, low, close), n), (high + low) / 2
    line, side = np.full(len(close), np.nan), np.full(len(close), np.nan)
    up = down = np.nan
    now = 1
    for i in range(len(close)):
        if atr[i] != atr[i]:
            continue
        raw_up, raw_down = middle[i] + k * atr[i], middle[i] - k * atr[i]
        up = raw_up if up != up or raw_up < up or close[i - 1] > up else up
        down = raw_down if down != down or raw_down > down or close[i - 1] < down else down
        now = 1 if close[i] > up else -1 if close[i] < down else now
        if now == 1:
            line[i], side[i] = down, 1
        else:
            line[i], side[i] = up, -1
    return line, side


def parabolic_sar(high: np.ndarray, low: np.ndarray, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    out = np.full(len(high), np.nan)
    if len(high) < 2:
        return out
    rising = high[1] + low[1] >= high[0] + low[0]
    sar, peak, rate = (low[0], high[0], step) if rising else (high[0], low[0], step)
    for i in range(1, len(high)):
        sar += rate * (peak - sar)
        before = slice(max(0, i - 2), i)
        sar = min(sar, low[before].min()) if rising else max(sar, high[before].max())
        if (low[i] < sar) if rising else (high[i] > sar):
            rising, sar, rate = not rising, peak, step
            peak = high[i] if rising else low[i]
        elif (high[i] > peak) if rising else (low[i] < peak):
            peak, rate = (high[i] if rising else low[i]), min(most, rate + step)
        out[i] = sar
    return out


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = seeded_ema(close, fast) - seeded_ema(close, slow)
    return line, seeded_ema(line, signal)


def indicator_columns(bars: pd.DataFrame) -> dict[str, np.ndarray]:
    """All recursive indicators of one symbol's bars in time order."""
    high, low, close = (bars[c].to_numpy(float) for c in ("high", "low", "close"))
    out = {f"ema_{n}": seeded_ema(close, n) for n in (5, 10, 20, 50, 200)} | {f"rsi_{n}": rsi(close, n) for n in (7, 14, 21)}
    out["macd"], out["macd_signal"] = macd(close)
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    out["atr_14"] = wilder(true_range(high, low, close), 14)
    middle, width = seeded_ema(close, 20), wilder(true_range(high, low, close), 20)
    out["keltner_upper"], out["keltner_lower"] = middle + 2 * width, middle - 2 * width
    out["supertrend"], out["supertrend_side"] = supertrend(high, low, close)
    out["psar"] = parabolic_sar(high, low)
    for span in (7, 14, 30):
        mean, var = ewm_moments(close, span)
        out |= {f"ewm_mean_{span}": mean, f"ewm_std_{span}": np.sqrt(var), f"ewm_var_{span}": var}
    return out


NAMES = [
    "ema_5", "ema_10", "ema_20", "ema_50", "ema_200", "rsi_7", "rsi_14", "rsi_21", "macd", "macd_signal", "macd_hist", "atr_14", "keltner_upper", "keltner_lower", "supertrend",
    "supertrend_side", "psar", *[f"ewm_{m}_{n}" for n in (7, 14, 30) for m in ("mean", "std", "var")],
]


def by_symbol(bars: DataFrame, kernel: Callable[[pd.DataFrame], dict], names: list[str]) -> DataFrame:
    """symbol, open_time and the columns that ``kernel`` makes of each symbol's bars in time order; NaN comes out as null."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("open_time", kind="stable").reset_index(drop=True)
        found = pd.DataFrame(kernel(rows), columns=names).astype(float)
        return pd.concat([rows[["symbol", "open_time"]], found.astype(object).where(found.notna(), None)], axis=1)

    return bars.groupBy("symbol").applyInPandas(run, f"{BARS}, " + ", ".join(f"{n} double" for n in names))


def recursive_indicators(bars: DataFrame) -> DataFrame:
    return by_symbol(bars, indicator_columns, NAMES)
