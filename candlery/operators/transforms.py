"""Transforms of series with what it takes to undo them, steps by name, spectra and feature selection."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAMBDAS = [k / 10 for k in range(-20, 21)]


def order():
    return Window.partitionBy("symbol").orderBy("open_time")


def box_cox(x: Column, power: Column) -> Column:
    return F.when(F.abs(power) < 1e-9, F.ln(x)).otherwise((F.pow(x, power) - 1) / power)


def fitted_power(bars: DataFrame, column: str = "close") -> DataFrame:
    """symbol, power, offset: the Box-Cox power of a grid with the greatest likelihood, of values raised above zero by
    ``offset``; one aggregation over the values and the grid."""
    low = bars.groupBy("symbol").agg(F.min(column).alias("_lo"))
    rows = bars.where(F.col(column).isNotNull()).join(low, "symbol").withColumn("offset", F.when(F.col("_lo") <= 0, 1 - F.col("_lo")).otherwise(0.0))
    grid = rows.select("symbol", "offset", (F.col(column) + F.col("offset")).alias("x"), F.explode(F.array(*map(F.lit, LAMBDAS))).alias("power"))
    spread = F.var_pop(box_cox(F.col("x"), F.col("power")))
    likelihood = F.when(spread > 0, -F.count("*") / 2 * F.ln(spread) + (F.col("power") - 1) * F.sum(F.ln("x")))
    each = grid.groupBy("symbol", "offset", "power").agg(likelihood.alias("ll")).where("ll is not null")
    best = each.groupBy("symbol").agg(F.max(F.struct("ll", (-F.abs("power")).alias("near"), "power", "offset")).alias("b"))
    return best.select("symbol", "b.power", "b.offset")


def transformed(bars: DataFrame, method: str, column: str = "close") -> DataFrame:
    """The bars with value, and power and offset where the inverse needs them: log, sqrt, boxcox, yeojohnson (power fitted
    as Box-Cox of value + 1 above zero), diff or none."""
    x = F.col(column)
    if method in ("boxcox", "yeojohnson"):
        shift = 0 if method == "boxcox" else 1
        fits = fitted_power(bars.withColumn(column, x + shift), column)
        rows = bars.join(fits, "symbol").withColumn("offset", F.col("offset") + shift)
        return rows.withColumn("value", box_cox(x + F.col("offset"), F.col("power")))
    low = F.min(column).over(Window.partitionBy("symbol")) if method in ("log", "sqrt") else F.lit(1.0)
    rows = bars.withColumns({"power": F.lit(None).cast("double"), "offset": F.when(low <= 0, 1 - low).otherwise(0.0)})
    value = {"log": F.ln(x + F.col("offset")), "sqrt": F.sqrt(x + F.col("offset")), "diff": x - F.lag(column).over(order()), "none": x}
    if method not in value:
        raise ValueError(f"unknown method: {method}")
    return rows.withColumn("value", value[method])


def restored(rows: DataFrame, method: str, column: str = "close") -> DataFrame:
    """The transformed rows with restored: what the column was, from value, power and offset (diff: from the value before)."""
    v, p = F.col("value"), F.col("power")
    inverse = {
        "log": F.exp(v) - F.col("offset"), "sqrt": v * v - F.col("offset"), "none": v, "diff": F.coalesce(F.lag(column).over(order()) + v, F.col(column)),
        "boxcox": F.when(F.abs(p) < 1e-9, F.exp(v)).otherwise(F.pow(v * p + 1, 1 / p)) - F.col("offset"),
    }
    inverse["yeojohnson"] = inverse["boxcox"]
    return rows.withColumn("restored", inverse[method])


def run_operations(bars: DataFrame, operations: Sequence[tuple[str, dict]], column: str = "close") -> DataFrame:
    """symbol, open_time, value after the named operations in order; unknown names raise before anything is built.

    log, sqrt, diff(lag), clip_outliers(k quartile ranges), moving_average(window, center), minmax, zscore.
    """
    known = {"log", "sqrt", "diff", "clip_outliers", "moving_average", "minmax", "zscore"}
    unknown = [n for n, _ in operations if n not in known]
    if unknown:
        raise ValueError(f"unknown operations: {unknown}")
    rows, v = bars.select("symbol", "open_time", F.col(column).alias("value")), F.col("value")
    for name, given in operations:
        if name in ("log", "sqrt"):
            rows = rows.withColumn("value", F.when(v > 0, F.ln(v)) if name == "log" else F.when(v >= 0, F.sqrt(v)))
        elif name == "diff":
            rows = rows.withColumn("value", v - F.lag("value", given.get("lag", 1)).over(order()))
        elif name == "moving_average":
            n = given.get("window", 5)
            frame = order().rowsBetween(-(n // 2), n - 1 - n // 2) if given.get("center", True) else order().rowsBetween(1 - n, 0)
            rows = rows.withColumn("value", F.when(F.count("value").over(frame) == n, F.avg("value").over(frame)))
        else:
            stats = {"a": F.percentile("value", 0.25), "b": F.percentile("value", 0.75)} if name == "clip_outliers" else {"a": F.min("value"), "b": F.max("value")} if name == "minmax" else {"a": F.avg("value"), "b": F.stddev_pop("value")}
            rows = rows.join(rows.groupBy("symbol").agg(*[x.alias(f"_{k}") for k, x in stats.items()]), "symbol")
            a, b, k = F.col("_a"), F.col("_b"), given.get("k", 1.5)
            value = F.greatest(a - k * (b - a), F.least(b + k * (b - a), v)) if name == "clip_outliers" else F.try_divide(v - a, b - a) if name == "minmax" else F.try_divide(v - a, b)
            rows = rows.withColumn("value", F.when(v.isNotNull(), value)).drop("_a", "_b")
    return rows


def periodogram(bars: DataFrame, column: str = "close", top: int = 5) -> DataFrame:
    """symbol, place, period (bars), power: the strongest frequencies of the centred series by a discrete Fourier transform
    written as one aggregation of rows by frequencies; place 1 is the strongest."""
    rows = bars.select("symbol", (F.row_number().over(order()) - 1).alias("t"), F.col(column).alias("x"))
    size = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("x").alias("mu"))
    waves = rows.join(size, "symbol").where("n >= 4").select("symbol", "n", (F.col("x") - F.col("mu")).alias("x"), "t", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))).alias("k"))
    angle = 2 * F.pi() * F.col("k") * F.col("t") / F.col("n")
    spectrum = waves.groupBy("symbol", "n", "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    found = spectrum.withColumns({"period": F.col("n") / F.col("k"), "power": (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")})
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("power"), "k"))
    return found.withColumn("place", place).where(F.col("place") <= top).select("symbol", "place", "period", "power")


def mutual_information(rows: DataFrame, columns: Sequence[str], label: str, bins: int = 8) -> DataFrame:
    """feature, mi (nats): mutual information of each column with the label, both cut into ``bins`` by quantiles."""
    known = rows.dropna(subset=[*columns, label]).select(*columns, label)
    cuts = known.agg(*[F.percentile(c, F.lit([k / bins for k in range(1, bins)])).alias(f"_{c}") for c in (*columns, label)])
    coded = known.crossJoin(F.broadcast(cuts))  # one row of cuts
    bin_of = lambda c: F.size(F.filter(f"_{c}", lambda q: q < F.col(c)))
    long = coded.select(bin_of(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("x")) for c in columns])).alias("f")).select("y", "f.*")
    joint = long.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    w = lambda *by: Window.partitionBy("feature", *by)  # noqa: E731  rows here are cells of a table of bins
    shares = joint.withColumns({"nx": F.sum("n").over(w("x")), "ny": F.sum("n").over(w("y")), "total": F.sum("n").over(w())})
    part = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.sum(part).alias("mi"))


def eliminated(rows: DataFrame, columns: Sequence[str], label: str, keep: int) -> DataFrame:
    """feature, place: features in the order of recursive elimination by the least standardised coefficient of a linear model;
    place 1 for those kept. Each round solves normal equations that one aggregation gives."""
    import numpy as np

    names = list(columns)
    known = rows.dropna(subset=[*names, label])
    pairs = {(a, b): F.covar_pop(a, b) for a, b in combinations_with_replacement([*names, label], 2)}
    got = known.agg(*[v.alias(f"{a}|{b}") for (a, b), v in pairs.items()]).first()
    cov = lambda a, b: got[f"{a}|{b}"] if f"{a}|{b}" in got.__fields__ else got[f"{b}|{a}"]
    left, places = list(names), {}
    while len(left) > keep:
        sd = np.sqrt([max(cov(c, c) or 0.0, 1e-300) for c in left])
        gram = np.array([[(cov(a, b) or 0.0) for b in left] for a in left]) / np.outer(sd, sd)
        beta = np.linalg.lstsq(gram, np.array([(cov(c, label) or 0.0) for c in left]) / sd, rcond=None)[0]
        worst = left[int(np.argmin(np.abs(beta)))]
        places[worst] = len(left) - keep + 1
        left.remove(worst)
    return rows.sparkSession.createDataFrame([(c, places.get(c, 1)) for c in names], "feature string, place long")


def polynomial_features(bars: DataFrame, columns: Sequence[str], most: int = 50, clip: float = 5.0) -> DataFrame:
    """symbol, open_time and the products of all pairs of the columns that vary most (by coefficient of variation), each
    standardised in its symbol and clipped; columns that don't vary at all are left out."""
    stats = bars.agg(*[F.try_divide(F.stddev_pop(c), F.abs(F.avg(c))).alias(c) for c in columns]).first()
    picked = sorted((c for c in columns if (stats[c] or 0) > 0), key=lambda c: (-stats[c], c))[:most]
    held = bars.groupBy("symbol").agg(*[F.avg(c).alias(f"_m_{c}") for c in picked], *[F.stddev_pop(c).alias(f"_s_{c}") for c in picked])
    z = {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))))) for c in picked}
    rows = bars.join(held, "symbol").select("symbol", "open_time", *[x.alias(c) for c, x in z.items()])
    return rows.select("symbol", "open_time", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations_with_replacement(sorted(picked), 2)])


def banded_predictions(predictions: DataFrame, share: float = 0.1) -> DataFrame:
    """Predictions with lower and upper: ``share`` of the value on either side, less as confidence nears 1."""
    width = F.abs("forecast") * share * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
    return predictions.withColumns({"lower": F.col("forecast") - width, "upper": F.col("forecast") + width})


def cross_ratios(bars: DataFrame, over: Sequence[str], under: Sequence[str], keys: Sequence[str] = ("symbol", "open_time"), clip: float = 0.01) -> DataFrame:
    """keys and a column for every pair of two different columns: their ratio, the symbol's median ratio where the lower one is zero,
    clipped to the symbol's outer percentiles. All statistics come from one aggregation."""
    pairs = {f"{a}_per_{b}": F.try_divide(a, F.nullif(F.col(b), F.lit(0.0))) for a in over for b in under if a != b}
    rows = bars.select(*keys, *[x.alias(k) for k, x in pairs.items()])
    cuts = rows.groupBy("symbol").agg(*[F.percentile(k, F.lit([clip, 0.5, 1 - clip])).alias(f"_{k}") for k in pairs])
    held = {k: F.greatest(F.col(f"_{k}")[0], F.least(F.col(f"_{k}")[2], F.coalesce(F.col(k), F.col(f"_{k}")[1]))) for k in pairs}
    return rows.join(cuts, "symbol").select(*keys, *[x.alias(k) for k, x in held.items()])
