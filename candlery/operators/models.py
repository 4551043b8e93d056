"""Time-series and learning operators that need a numeric kernel, one symbol's bars at a time, or pyspark.ml."""

from __future__ import annotations

import json
from math import erfc, exp, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlery.operators.recursive import by_symbol

# Published critical values (1, 5, 10 percent) of the Dickey-Fuller test with constant, and of KPSS.
ADF_CRITICAL, KPSS_CRITICAL = (-3.43, -2.86, -2.57), (0.739, 0.463, 0.347)


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, their standard errors and the residuals of a least-squares fit."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    scale = rest @ rest / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.maximum(0, scale * np.diag(np.linalg.pinv(x.T @ x)))), rest


def adf(x: np.ndarray, lags: int = 1) -> float:
    """Augmented Dickey-Fuller statistic with constant; NaN for too short or constant series."""
    d = np.diff(x)
    if len(d) < lags + 5 or np.ptp(x) == 0:
        return float("nan")
    y = d[lags:]
    columns = [x[lags:-1], np.ones(len(y))] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
    beta, error, _ = _ols(y, np.column_stack(columns))
    return beta[0] / error[0] if error[0] else float("nan")


def kpss(x: np.ndarray) -> float:
    """KPSS statistic around a level, Bartlett weights over 4 (n/100)^(1/4) lags."""
    if len(x) < 8 or np.ptp(x) == 0:
        return float("nan")
    e, n = x - x.mean(), len(x)
    lags = int(4 * (n / 100) ** 0.25)
    s2 = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / n**2 / s2


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    e = x - x.mean()
    total = e @ e
    return np.array([np.nan if total == 0 or k >= len(e) else (e[k:] @ e[: len(e) - k]) / total for k in range(1, lags + 1)])


def pacf(x: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelations by the Durbin-Levinson recursion."""
    r, out, phi = np.concatenate([[1.0], acf(x, lags)]), [], np.zeros(0)
    for k in range(1, lags + 1):
        top = r[k] - (phi @ r[k - 1 : 0 : -1] if k > 1 else 0)
        bottom = 1 - (phi @ r[1:k] if k > 1 else 0)
        last = top / bottom if bottom else np.nan
        phi = np.concatenate([phi - last * phi[::-1], [last]])
        out.append(last)
    return np.array(out)


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-square, from the closed forms for whole degrees of freedom."""
    if x != x or x <= 0:
        return 1.0 if x == x else float("nan")
    if k % 2 == 0:
        term = total = exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    total, term = erfc(sqrt(x / 2)), sqrt(2 * x / pi) * exp(-x / 2)
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return min(1.0, total)


def _per_symbol(bars: DataFrame, fields: str, kernel) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("open_time", kind="stable")
        out = pd.DataFrame(kernel(rows), columns=[f.split()[0] for f in fields.split(", ")])
        out.insert(0, "symbol", rows["symbol"].iloc[0])
        return out

    return bars.groupBy("symbol").applyInPandas(run, f"symbol string, {fields}")


def stationarity(bars: DataFrame) -> DataFrame:
    """symbol, form (level, diff, log_return), adf, kpss and the joint verdict at five percent."""

    def kernel(rows: pd.DataFrame) -> list:
        close = rows["close"].to_numpy(float)
        close = close[close > 0]
        out = []
        for form, x in (("level", close), ("diff", np.diff(close)), ("log_return", np.diff(np.log(close)))):
            a, k = adf(x), kpss(x)
            votes = int(a < ADF_CRITICAL[1]) + int(k < KPSS_CRITICAL[1])
            out.append((form, a, k, ("not stationary", "unclear", "stationary")[votes]))
        return out

    return _per_symbol(bars, "form string, adf double, kpss double, verdict string", kernel)


def seasonality(bars: DataFrame, most: int = 48) -> DataFrame:
    """symbol, period, acf, strength: local peaks of the autocorrelation and the variance that their season explains."""

    def kernel(rows: pd.DataFrame) -> list:
        x = rows["close"].to_numpy(float)
        if len(x) < 10:
            return []
        r = acf(x, min(most, len(x) // 2))
        out = []
        for k in range(2, len(r)):
            if r[k - 1] > r[k - 2] and r[k - 1] >= r[k] and r[k - 1] > 1.96 / sqrt(len(x)):
                trend = pd.Series(x).rolling(k, center=True, min_periods=1).mean().to_numpy()
                rest = x - trend
                season = pd.Series(rest).groupby(np.arange(len(x)) % k).transform("mean").to_numpy()
                out.append((k, r[k - 1], season.var() / x.var() if x.var() else np.nan))
        return out

    return _per_symbol(bars, "period long, acf double, strength double", kernel)


def fit_arma(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hannan-Rissanen estimate of an ARMA model with constant: coefficients (constant, AR, MA), residuals and AIC."""
    n, long = len(x), max(p, q, 1) + 6
    if n < 3 * long:
        return np.zeros(0), np.zeros(0), float("inf")
    lagged = lambda s, k, a: np.column_stack([s[a - i : len(s) - i] for i in range(1, k + 1)]) if k else np.zeros((len(s) - a, 0))
    _, _, rest = _ols(x[long:], np.column_stack([np.ones(n - long), lagged(x, long, long)]))
    e = np.concatenate([np.zeros(long), rest])
    at = long + max(p, q)
    design = np.column_stack([np.ones(n - at), lagged(x, p, at), lagged(e, q, at)])
    beta, _, rest = _ols(x[at:], design)
    return beta, rest, len(rest) * log(max(rest @ rest / len(rest), 1e-300)) + 2 * (1 + p + q)


def best_arma(x: np.ndarray, most: int = 3) -> tuple[int, int, np.ndarray, np.ndarray]:
    grid = [(p, q, *fit_arma(x, p, q)) for p in range(most + 1) for q in range(most + 1)]
    p, q, beta, rest, _ = min(grid, key=lambda g: g[4])
    return p, q, beta, rest


def forecast_arma(x: np.ndarray, p: int, q: int, beta: np.ndarray, rest: np.ndarray, steps: int) -> np.ndarray:
    past, errors, out = list(x), list(rest), []
    for _ in range(steps):
        value = beta[0] + sum(beta[i] * past[-i] for i in range(1, p + 1)) + sum(beta[p + i] * errors[-i] for i in range(1, q + 1))
        out.append(value)
        past.append(value)
        errors.append(0.0)
    return np.array(out)


def psi_weights(p: int, q: int, beta: np.ndarray, steps: int, d: int = 0) -> np.ndarray:
    """How a shock moves the value so many steps later (1 at once), of coefficients (constant, AR, MA) and d differences."""
    ar, ma = np.asarray(beta[1 : 1 + p], float), np.asarray(beta[1 + p : 1 + p + q], float)
    psi = np.zeros(steps)
    psi[0] = 1.0
    for j in range(1, steps):
        psi[j] = (ma[j - 1] if j <= q else 0.0) + sum(ar[i - 1] * psi[j - i] for i in range(1, min(p, j) + 1))
    for _ in range(d):
        psi = np.cumsum(psi)
    return psi


def arima_forecast(bars: DataFrame, steps: int = 5, step_seconds: int = 14_400) -> DataFrame:
    """symbol, ahead, forecast, lower, upper and the chosen orders (d = 1 if the level isn't stationary)."""

    def kernel(rows: pd.DataFrame) -> list:
        x = rows["close"].to_numpy(float)
        if len(x) < 40:
            return []
        d = 0 if adf(x) < ADF_CRITICAL[1] else 1
        z = np.diff(x) if d else x
        p, q, beta, rest = best_arma(z)
        if not len(beta):
            return []
        ahead = forecast_arma(z, p, q, beta, rest, steps)
        value = x[-1] + np.cumsum(ahead) if d else ahead
        width = 1.96 * rest.std() * np.sqrt(np.cumsum(psi_weights(p, q, beta, steps, d) ** 2))
        return [(i + 1, value[i], value[i] - width[i], value[i] + width[i], p, d, q) for i in range(steps)]

    return _per_symbol(bars, "ahead long, forecast double, lower double, upper double, p long, d long, q long", kernel)


def _metrics(actual: np.ndarray, predicted: np.ndarray) -> tuple[float, float, float, float]:
    e = actual - predicted
    spread = ((actual - actual.mean()) ** 2).sum()
    nonzero = actual != 0
    return float((e**2).mean()), float(np.abs(e).mean()), float(100 * np.abs(e[nonzero] / actual[nonzero]).mean()) if nonzero.any() else float("nan"), float(1 - (e**2).sum() / spread) if spread else float("nan")


def rolling_validation(bars: DataFrame, window: int = 100, step: int = 20, horizon: int = 10) -> DataFrame:
    """symbol, origin, mse, mae, mape, r2 of an AR(2) fitted anew at each origin."""

    def kernel(rows: pd.DataFrame) -> list:
        x, out = rows["close"].to_numpy(float), []
        for at in range(window, len(x) - horizon + 1, step):
            past = x[at - window : at]
            beta, rest, _ = fit_arma(past, 2, 0)
            out.append((at, *_metrics(x[at : at + horizon], forecast_arma(past, 2, 0, beta, rest, horizon))))
        return out

    return _per_symbol(bars, "origin long, mse double, mae double, mape double, r2 double", kernel)


def residual_tests(bars: DataFrame, lags: int = 10) -> DataFrame:
    """symbol, Ljung-Box, Jarque-Bera and Breusch-Pagan statistics of an AR(1)'s residuals with their p-values."""

    def kernel(rows: pd.DataFrame) -> list:
        x = rows["close"].to_numpy(float)
        if len(x) < 40:
            return []
        _, e, _ = fit_arma(x, 1, 0)
        n, z = len(e), (e - e.mean()) / (e.std() or 1)
        r = acf(e, lags)
        lb = n * (n + 2) * sum(r[k - 1] ** 2 / (n - k) for k in range(1, lags + 1))
        jb = n / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
        t = np.column_stack([np.ones(n), np.arange(n)])
        _, _, rest = _ols(e**2, t)
        total = ((e**2 - (e**2).mean()) ** 2).sum()
        bp = n * (1 - rest @ rest / total) if total else 0.0
        return [(n, e.mean(), e.std(), lb, chi2_tail(lb, lags), jb, chi2_tail(jb, 2), bp, chi2_tail(bp, 1), json.dumps(np.round(pacf(e, 3), 6).tolist()))]

    return _per_symbol(bars, "n long, mean double, sd double, ljung_box double, lb_p double, jarque_bera double, jb_p double, breusch_pagan double, bp_p double, pacf string", kernel)


def garch(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """symbol, omega, alpha, beta, persistence, half_life and the variance forecast of a GARCH(1,1) on log returns.

    Variance targeting leaves two parameters, found on a refined grid of the Gaussian likelihood.
    """

    def kernel(rows: pd.DataFrame) -> list:
        close = rows["close"].to_numpy(float)
        r = np.diff(np.log(close[close > 0]))
        if len(r) < 30 or r.var() == 0:
            return []
        r, target = r - r.mean(), r.var()

        def loss(a: float, b: float) -> tuple[float, float]:
            h, total, omega = target, 0.0, target * (1 - a - b)
            for v in r:
                total += log(h) + v * v / h
                h = omega + a * v * v + b * h
            return total, h

        best, span, centre = (float("inf"), 0.05, 0.9, target), 1.0, (0.25, 0.5)
        for _ in range(4):
            for a in np.linspace(max(0.001, centre[0] - 0.25 * span), min(0.5, centre[0] + 0.25 * span), 7):
                for b in np.linspace(max(0.0, centre[1] - 0.5 * span), min(0.998, centre[1] + 0.5 * span), 7):
                    if a + b < 0.999:
                        value, h = loss(a, b)
                        if value < best[0]:
                            best = value, a, b, h
            centre, span = best[1:3], span / 3
        _, a, b, h = best
        path = [target + (a + b) ** k * (h - target) for k in range(horizon)]
        return [(target * (1 - a - b), a, b, a + b, log(0.5) / log(a + b) if 0 < a + b < 1 else float("nan"), json.dumps(np.round(path, 10).tolist()))]

    return _per_symbol(bars, "omega double, alpha double, beta double, persistence double, half_life double, path string", kernel)


def impulse_response(fits: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 4, 5, 10, 20)) -> DataFrame:
    """symbol, horizon, base (long-run variance), shocked (variance so many steps after a return of one deviation beyond the
    expected square), half_life: closed form of the fitted GARCH(1,1)."""
    rows = fits.withColumn("base", F.try_divide("omega", 1 - F.col("persistence"))).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    shocked = F.col("base") + F.col("alpha") * F.col("base") * F.pow("persistence", F.col("horizon") - 1)
    return rows.select("symbol", "horizon", "base", shocked.alias("shocked"), "half_life")


def isolation_scores(bars: DataFrame, trees: int = 300, sample: int = 256, seed: int = 42) -> DataFrame:
    """symbol, open_time, score of an isolation forest on returns, range and volume (near 1: easily set apart)."""

    def kernel(rows: pd.DataFrame) -> dict:
        close = rows["close"].to_numpy(float)
        x = np.column_stack([np.diff(close, prepend=close[0]), rows["high"] - rows["low"], rows["volume"]]).astype(float)
        x = np.nan_to_num(x)
        rng, n = np.random.default_rng(seed), len(x)
        size = min(sample, n)
        average = lambda m: 0.0 if m <= 1 else 2 * (log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else 1.0
        depth = np.zeros(n)

        def grow(fit: np.ndarray, idx: np.ndarray, level: int) -> None:
            if not len(idx):
                return
            ranges = np.ptp(x[fit], axis=0) if len(fit) else np.zeros(x.shape[1])
            if level >= 8 or len(fit) <= 1 or not ranges.any():
                depth[idx] += level + average(len(fit))
                return
            f = rng.choice(np.flatnonzero(ranges))
            cut = rng.uniform(x[fit, f].min(), x[fit, f].max())
            grow(fit[x[fit, f] < cut], idx[x[idx, f] < cut], level + 1)
            grow(fit[x[fit, f] >= cut], idx[x[idx, f] >= cut], level + 1)

        for _ in range(trees):
            grow(rng.choice(n, size, replace=False), np.arange(n), 0)
        return {"score": 2.0 ** (-depth / trees / max(average(size), 1e-9))}

    return by_symbol(bars, kernel, ["score"])


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    complete = rows.dropna(subset=columns)
    packed = VectorAssembler(inputCols=columns, outputCol="raw").transform(complete)
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(packed).transform(packed)


def regimes(features: DataFrame, column: str, k: int = 3, seed: int = 42) -> DataFrame:
    """symbol, open_time, regime (0 calmest): k-means on one volatility column, clusters ordered by their centre."""
    rows = _vectors(features, [column])
    labelled = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
    centres = labelled.groupBy("cluster").agg(F.avg(column).alias("centre"))
    ranked = centres.withColumn("regime", (F.row_number().over(Window.orderBy("centre")) - 1).cast("long"))
    return labelled.join(F.broadcast(ranked), "cluster").select("symbol", "open_time", column, "regime")


def principal_components(features: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """symbol, open_time, pc_1..pc_k of standardised columns for every row (signs are arbitrary, so the first loading is made positive).

    A missing value counts as the median of its column, as in the reference; a column without any value is left out of account.
    There are no more components than columns or rows: those beyond are null.
    """
    rows = features.select("symbol", "open_time", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    found = rows.agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in columns]).first()
    rows = rows.fillna({c: 0.0 if found[c] is None else found[c] for c in columns})
    have = min(k, len(columns), found["n"])
    if found["n"] < 2:  # nothing to fit: a single row is the mean
        parts = [F.lit(0.0)] * have
    else:
        rows = _vectors(rows, columns)
        model = PCA(k=have, inputCol="features", outputCol="pcs").fit(rows)
        rows, values, loadings = model.transform(rows), vector_to_array("pcs"), model.pc.toArray()
        parts = [values[i] * (1.0 if loadings[0, i] >= 0 else -1.0) for i in range(have)]
    parts += [F.lit(None).cast("double")] * (k - have)
    return rows.select("symbol", "open_time", *[x.alias(f"pc_{i + 1}") for i, x in enumerate(parts)])


def return_regression(features: DataFrame, columns: list[str], label: str, share: float = 0.8) -> DataFrame:
    """One row: rmse, r2 and n of a linear regression fitted on the first ``share`` of time and tried on the rest."""
    rows = features.dropna(subset=[*columns, label])
    place = rows.withColumn("at", F.percent_rank().over(Window.partitionBy("symbol").orderBy("open_time")))
    packed = VectorAssembler(inputCols=columns, outputCol="features").transform(place)
    model = LinearRegression(featuresCol="features", labelCol=label).fit(packed.where(F.col("at") < share))
    tried = model.transform(packed.where(F.col("at") >= share)).withColumn("e2", (F.col(label) - F.col("prediction")) ** 2)
    r2 = 1 - F.sum("e2") / F.nullif(F.var_pop(label) * F.count("*"), F.lit(0.0))
    return tried.agg(F.sqrt(F.avg("e2")).alias("rmse"), r2.alias("r2"), F.count("*").alias("n"))


def feature_scores(features: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, r, f_score: univariate regression F of each column against the label, in one aggregation."""
    rows = features.dropna(subset=[*columns, label])
    sums = rows.agg(F.count("*").alias("n"), *[F.try_divide(F.covar_samp(c, label), F.nullif(F.stddev_samp(c) * F.stddev_samp(label), F.lit(0.0))).alias(c) for c in columns])
    long = sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns])).alias("x")).select("n", "x.*")
    r2 = F.col("r") * F.col("r")
    return long.select("feature", F.round("r", 6).alias("r"), F.round(F.try_divide(r2, F.nullif(1 - r2, F.lit(0.0))) * (F.col("n") - 2), 4).alias("f_score"))


def sequences(features: DataFrame, columns: list[str], length: int = 30, step: int = 10) -> DataFrame:
    """sequence_id, symbol, position and the columns: complete windows of ``length`` bars, beginning every ``step``.

    Each bar is exploded to the windows that hold it (length / step of them); incomplete ones are dropped.
    """
    order = Window.partitionBy("symbol").orderBy("open_time")
    rows = features.withColumn("rn", F.row_number().over(order) - 1).withColumn("total", F.count("*").over(Window.partitionBy("symbol")))
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - length + 1) / step)) * step
    starts = F.when(first <= F.col("rn"), F.sequence(first, F.col("rn"), F.lit(step).cast("long")))
    held = rows.select("symbol", "open_time", *columns, "rn", "total", F.explode(starts).alias("start")).where(F.col("start") + length <= F.col("total"))
    return held.select(F.concat_ws("-", "symbol", "start").alias("sequence_id"), "symbol", (F.col("rn") - F.col("start")).alias("position"), *columns)
