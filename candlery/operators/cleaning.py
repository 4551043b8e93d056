"""Frames of bars made fit for analysis: types, duplicates, repairs, gaps, fills and scaling, with reports of what is wrong.

``keys`` tell the series of a frame apart and ``time`` orders a series; all operators leave other columns alone. Statistics
of a series are aggregated on the map side and joined back, so no window holds a whole series for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
BARS = (*PRICES, "volume")
NUMBERS = (T.DecimalType, T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def along(keys: Sequence[str], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def so_far(keys: Sequence[str], time: str):
    """This row and all before it."""
    return along(keys, time).rowsBetween(Window.unboundedPreceding, 0)


def from_here(keys: Sequence[str], time: str):
    """This row and all after it, the last one first: read backwards, a frame only grows, while one that ends with the
    partition would be read anew for every row. Times of a series are distinct."""
    return Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)


def with_statistics(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """The frame with aggregates of each series beside its rows. Series with a null key keep theirs."""
    held = df.groupBy(*keys).agg(*[v.alias(k) for k, v in values.items()])
    held = held.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *values)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    return df.join(held, condition, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def prepared(df: DataFrame, time: str, numbers: Sequence[str]) -> DataFrame:
    """time as a zone-less timestamp and numbers as doubles; what can't be read is null, and rows without a time are left out."""
    typed = {time: F.col(time).try_cast("timestamp_ntz")} | {c: F.col(c).try_cast("double") for c in numbers}
    return df.withColumns(typed).where(F.col(time).isNotNull())


def as_doubles(df: DataFrame) -> DataFrame:
    """Every decimal or integer column as double, others as they are."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, NUMBERS) else F.col(f.name) for f in df.schema.fields])


def first_of_time(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str]) -> DataFrame:
    """The first row by ``order`` of each series and time, combined before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, time, *order)]
    first = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys, time).agg(first).select(*keys, time, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def column_report(df: DataFrame, essential: Sequence[str] = BARS) -> DataFrame:
    """column_name, present, known, negative, infinite of each essential column (counts are null if it is absent)."""
    there = [c for c in essential if c in df.columns]
    x = {c: F.col(c).cast("double") for c in there}
    counts = [F.struct(F.count(x[c]).alias("known"), F.count_if(x[c] < 0).alias("negative"), F.count_if(F.abs(x[c]) == float("inf")).alias("infinite")).alias(c) for c in there]
    one = df.agg(F.count("*").alias("n"), *counts)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in there).cast("long").alias("present"), *[(F.col(f"{c}.{k}") if c in there else F.lit(None).cast("long")).alias(k) for k in ("known", "negative", "infinite")]) for c in essential]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_gaps(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """previous (time of the row before) and gap_s (seconds since it)."""
    before = F.lag(time).over(along(keys, time))
    return df.withColumns({"previous": before, "gap_s": F.timestamp_diff("SECOND", before, F.col(time))})


def missing_periods(df: DataFrame, keys: Sequence[str], time: str, factor: float = 1.5) -> DataFrame:
    """keys, gap_start, gap_end, gap_s, missing: steps longer than ``factor`` times the median step of their series."""
    gaps = with_gaps(df.select(*keys, time), keys, time)
    found = with_statistics(gaps, keys, {"step": F.percentile("gap_s", 0.5)}).where(F.col("gap_s") > factor * F.col("step"))
    return found.select(*keys, F.col("previous").alias("gap_start"), F.col(time).alias("gap_end"), "gap_s", (F.round(F.col("gap_s") / F.col("step")) - 1).cast("long").alias("missing"))


def integrity_report(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """keys, issue, n, first_at: how often each thing is wrong in a series and when for the first time; one row each.

    Large gaps exceed twice the median step, small ones fall under a tenth of it; volume outliers lie over five scaled
    median deviations off the median; jumps move the close by more than a fifth.
    """
    w = along(keys, time)
    rows = with_gaps(df, keys, time).withColumn("moved", F.try_divide("close", F.lag("close").over(w)) - 1)
    rows = with_statistics(rows, keys, {"step": F.percentile("gap_s", 0.5), "usual": F.percentile("volume", 0.5)}).withColumn("away", F.abs(F.col("volume") - F.col("usual")))
    rows = with_statistics(rows, keys, {"mad": F.percentile("away", 0.5)})
    rules = {
        "large_gap": F.col("gap_s") > 2 * F.col("step"),
        "small_gap": (F.col("gap_s") > 0) & (F.col("gap_s") < 0.1 * F.col("step")),
        "repeated_time": F.col("gap_s") == 0,
        "high_below_low": F.col("high") < F.col("low"),
        "outside_range": (F.greatest("open", "close") > F.col("high")) | (F.least("open", "close") < F.col("low")),
        "no_price": F.least(*PRICES) <= 0,
        "no_volume": F.col("volume") == 0,
        "negative_volume": F.col("volume") < 0,
        "jump": F.abs("moved") > 0.2,
        "volume_outlier": F.col("away") > 5 * 1.4826 * F.col("mad"),
        "null_value": F.col("close").isNull() | F.col("volume").isNull(),
    }
    hit = F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("issue")
    return rows.select(*keys, time, hit).groupBy(*keys, "issue").agg(F.count("*").alias("n"), F.min(time).alias("first_at"))


def market_checks(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """keys, rows, repeated, nulls, high_below_low, outside_range, no_price, irregular, passed of each series.

    irregular counts steps other than the most frequent one (the shortest of equally frequent ones).
    """
    steps = with_gaps(df, keys, time)
    counted = steps.where("gap_s is not null").groupBy(*keys, "gap_s").agg(F.count("*").alias("n"))
    mode = counted.groupBy(*keys).agg((F.sum("n") - F.max(F.struct("n", -F.col("gap_s")))["n"]).alias("irregular"))
    checks = {
        "repeated": F.col("gap_s") == 0,
        "nulls": F.greatest(*[F.col(c).isNull() for c in BARS]),
        "high_below_low": F.col("high") < F.col("low"),
        "outside_range": (F.greatest("open", "close") > F.col("high")) | (F.least("open", "close") < F.col("low")),
        "no_price": F.least(*PRICES) <= 0,
    }
    one = steps.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    found = one.join(mode, list(keys), "left")
    found = found.withColumn("irregular", F.coalesce("irregular", F.lit(0)))
    bad = sum((F.col(c) for c in (*checks, "irregular")), F.lit(0))
    return found.withColumn("passed", (bad == 0).cast("long"))


def repaired_values(df: DataFrame, keys: Sequence[str], floor: float = 1e-4, far: float = 10.0) -> DataFrame:
    """Bars with impossible values repaired in order, and repair: the last repair that a bar needed, null if none.

    Negative prices become the median of the series' prices above zero (at least ``floor``); a high or low of zero becomes
    the greater or lesser of open and close; a negative volume becomes the median of those above zero, none the least of
    them (0.01 without any); volumes beyond the mean by ``far`` deviations are only flagged; at last high and low are
    widened to hold open and close.
    """
    stats = {f"_m_{c}": F.percentile(F.when(F.col(c) > 0, F.col(c)), 0.5) for c in BARS}
    stats |= {"_least": F.min(F.when(F.col("volume") > 0, F.col("volume"))), "_mean": F.avg("volume"), "_sd": F.stddev_samp("volume")}
    rows = with_statistics(df, keys, stats)
    flags = {"negative_price": F.least(*PRICES) < 0, "zero_range": (F.col("high") == 0) | (F.col("low") == 0), "negative_volume": F.col("volume") < 0, "no_volume": F.col("volume") == 0, "far_volume": F.col("volume") > F.col("_mean") + far * F.col("_sd")}
    rows = rows.withColumns({c: F.when(F.col(c) < 0, F.greatest(F.col(f"_m_{c}"), F.lit(floor))).otherwise(F.col(c)) for c in PRICES} | {f"_f_{k}": v for k, v in flags.items()})
    zero = lambda c, other: F.when(F.col(c) == 0, F.coalesce(F.when(other > 0, other), F.col(f"_m_{c}"), F.lit(floor))).otherwise(F.col(c))
    rows = rows.withColumns({"high": zero("high", F.greatest("open", "close")), "low": zero("low", F.least("open", "close"))})
    volume = F.when(F.col("volume") < 0, F.col("_m_volume")).when(F.col("volume") == 0, F.coalesce("_least", F.lit(0.01))).otherwise(F.col("volume"))
    envelope = (F.greatest(*PRICES) > F.col("high")) | (F.least(*PRICES) < F.col("low"))
    rows = rows.withColumns({"volume": volume, "_f_envelope": envelope})
    rows = rows.withColumns({"high": F.greatest(*PRICES), "low": F.least(*PRICES)})
    last = F.lit(None).cast("string")
    for name in (*flags, "envelope"):
        last = F.when(F.col(f"_f_{name}"), F.lit(name)).otherwise(last)
    return rows.select(*df.columns, last.alias("repair"))


def emptied_outliers(df: DataFrame, keys: Sequence[str], time: str, k: float = 3.0, jump: float = 0.5) -> DataFrame:
    """Bars whose prices outside of ``k`` quartile ranges are null, unless they came by a jump of more than ``jump`` and aren't twice as far out."""
    stats = {f"_q{q}_{c}": F.percentile(c, q / 4) for c in PRICES for q in (1, 3)}
    rows = with_statistics(df, keys, stats)
    w = along(keys, time)
    out = {}
    for c in PRICES:
        q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
        outside = lambda f, c=c, q1=q1, q3=q3: (F.col(c) > q3 + f * (q3 - q1)) | (F.col(c) < F.greatest(q1 - f * (q3 - q1), F.lit(0.0)))
        moved = F.coalesce(F.abs(F.try_divide(F.col(c), F.lag(c).over(w)) - 1) > jump, F.lit(False))
        out[c] = F.when(outside(k) & (~moved | outside(2 * k)), F.lit(None)).otherwise(F.col(c))
    return rows.withColumns(out).select(*df.columns)


def filled(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], method: str = "interpolate", limit: int | None = None) -> DataFrame:
    """Nulls of the columns filled within their series.

    interpolate: along the line of time between the values around a gap, then forward and backward; ffill: with the last
    value; mean, median: of the series. ``limit`` leaves what lies more than so many rows behind a value.
    """
    if method not in ("interpolate", "ffill", "mean", "median"):
        raise ValueError(f"unknown method: {method}")
    if method in ("mean", "median"):
        pick = F.avg if method == "mean" else F.median
        rows = with_statistics(df, keys, {f"_s_{c}": pick(c) for c in columns})
        return rows.withColumns({c: F.coalesce(F.col(c), F.col(f"_s_{c}")) for c in columns}).select(*df.columns)
    w = along(keys, time)
    back, ahead = so_far(keys, time), from_here(keys, time)
    rows = df.withColumns({"_rn": F.row_number().over(w), "_s": F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))})
    around = {}
    for c in columns:
        known = lambda x, c=c: F.when(F.col(c).isNotNull(), F.col(x))
        around |= {f"_v0_{c}": F.last(c, True).over(back), f"_t0_{c}": F.last(known("_s"), True).over(back), f"_r0_{c}": F.last(known("_rn"), True).over(back)}
        if method == "interpolate":
            around |= {f"_v1_{c}": F.last(c, True).over(ahead), f"_t1_{c}": F.last(known("_s"), True).over(ahead)}
    rows = rows.withColumns(around)
    out = {}
    for c in columns:
        v0, t0 = F.col(f"_v0_{c}"), F.col(f"_t0_{c}")
        if method == "ffill":
            value = v0
        else:
            v1, t1 = F.col(f"_v1_{c}"), F.col(f"_t1_{c}")
            value = F.coalesce(F.when(t1 > t0, v0 + (v1 - v0) * (F.col("_s") - t0) / (t1 - t0)), v0, v1)
        near = F.lit(True) if limit is None else F.coalesce(F.col("_rn") - F.col(f"_r0_{c}") <= limit, F.lit(False))
        out[c] = F.coalesce(F.col(c), F.when(near, value))
    return rows.withColumns(out).select(*df.columns)


def filled_by_class(df: DataFrame, keys: Sequence[str], time: str, limit: int = 5) -> DataFrame:
    """Gaps after resampling: prices on the line between their neighbours up to ``limit`` rows into a gap, then the nearest
    value as far; volumes and trades none; rates and fees the last value, else none; text the last value, else the next."""
    kinds = column_classes(df, (*keys, time))
    prices = [c for c, k in kinds.items() if k == "price"]
    w = along(keys, time)
    ends = {"back": so_far(keys, time), "ahead": from_here(keys, time)}
    rows = df.withColumns({"_rn": F.row_number().over(w), "_s": F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))})
    around = {}
    for c in prices:
        for n, side in (("0", "back"), ("1", "ahead")):
            around |= {f"_{k}{n}_{c}": F.last(F.when(F.col(c).isNotNull(), F.col(x)), True).over(ends[side]) for k, x in (("v", c), ("t", "_s"), ("r", "_rn"))}
    rows = rows.withColumns(around)
    out = {}
    for c in prices:
        v0, v1, t0, t1, r0, r1 = (F.col(f"_{k}_{c}") for k in ("v0", "v1", "t0", "t1", "r0", "r1"))
        line = F.when((t1 > t0) & (F.col("_rn") - r0 <= limit), v0 + (v1 - v0) * (F.col("_s") - t0) / (t1 - t0))
        out[c] = F.coalesce(F.col(c), line, F.when(F.col("_rn") - r0 <= 2 * limit, v0), F.when(r1 - F.col("_rn") <= limit, v1))
    for c, k in kinds.items():
        if k == "sum":
            out[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
        elif k == "mean":
            out[c] = F.coalesce(F.last(c, True).over(ends["back"]), F.lit(0.0))
        elif k in ("last", "text"):
            out[c] = F.coalesce(F.last(c, True).over(ends["back"]), F.last(c, True).over(ends["ahead"]))
    return rows.withColumns(out).select(*df.columns)


def column_classes(df: DataFrame, apart: Sequence[str]) -> dict[str, str]:
    """Each column's class by its name and type: price (open, high, low, close), sum (volumes, amounts, counts), mean
    (prices, rates and all other numbers), last (ids and codes), text."""
    out = {}
    for f in df.schema.fields:
        name = f.name.lower()
        if f.name in apart:
            continue
        if name in PRICES:
            out[f.name] = "price"
        elif not isinstance(f.dataType, NUMBERS):
            out[f.name] = "text"
        elif name == "id" or name.endswith(("_id", "_code")):
            out[f.name] = "last"
        elif any(x in name for x in ("volume", "amount", "count", "trades", "quantity")):
            out[f.name] = "sum"
        else:
            out[f.name] = "mean"
    return out


def ohlc_normalized(df: DataFrame, keys: Sequence[str], method: str = "minmax") -> DataFrame:
    """Bars scaled by their low, which is the base: z-score, min-max to 0.01..1 or robust, shifted above zero; open, high and
    close keep their ratios to it. base_shift, base_center and base_scale are what it takes to scale back."""
    if method not in ("zscore", "minmax", "robust"):
        raise ValueError(f"unknown method: {method}")
    spread = {"zscore": (F.avg("low"), F.stddev_pop("low")), "minmax": (F.min("low"), F.max("low") - F.min("low")), "robust": (F.percentile("low", 0.5), F.percentile("low", 0.75) - F.percentile("low", 0.25))}[method]
    rows = with_statistics(df, keys, {"base_center": spread[0], "base_scale": spread[1], "_min": F.min("low")})
    unit = lambda x: F.try_divide(x - F.col("base_center"), F.col("base_scale"))
    if method == "minmax":
        rows = rows.withColumns({"_base": 0.01 + 0.99 * unit(F.col("low")), "base_shift": F.lit(0.0)})
    else:
        shift = F.greatest(F.lit(0.0), 0.01 - unit(F.col("_min")))
        rows = rows.withColumns({"_base": unit(F.col("low")) + shift, "base_shift": shift})
    scaled = {c: F.col("_base") * F.try_divide(F.col(c), F.col("low")) for c in ("open", "high", "close")}
    return rows.withColumns(scaled).withColumn("low", F.col("_base")).select(*df.columns, "base_shift", "base_center", "base_scale")


def scaled_non_negative(df: DataFrame, keys: Sequence[str], column: str, method: str = "minmax") -> DataFrame:
    """The frame with {column}_scaled: min-max to 0..1, or a z-score raised by its least value, so never below zero."""
    c = F.col(column)
    rows = with_statistics(df, keys, {"_lo": F.min(c), "_hi": F.max(c), "_mu": F.avg(c), "_sd": F.stddev_pop(c)})
    value = F.try_divide(c - F.col("_lo"), F.col("_hi") - F.col("_lo") if method == "minmax" else F.col("_sd"))
    return rows.withColumn(f"{column}_scaled", value).drop("_lo", "_hi", "_mu", "_sd")


def anomaly_ready(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], fill: str = "median", skewed: float = 1.5) -> DataFrame:
    """Columns filled, and {column}_log = log(1 + x) of those without a negative value whose bias-corrected skewness in the
    series exceeds ``skewed``; null in series where it doesn't."""
    rows = filled(df, keys, time, columns, fill)
    stats = {}
    for c in columns:
        n = F.count(c).cast("double")
        stats |= {f"_k_{c}": F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)), f"_lo_{c}": F.min(c)}
    rows = with_statistics(rows, keys, stats)
    logs = {f"{c}_log": F.when((F.abs(f"_k_{c}") > skewed) & (F.col(f"_lo_{c}") >= 0), F.log1p(c)) for c in columns}
    return rows.withColumns(logs).drop(*stats)


def without_nulls(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], binary: Sequence[str] = (), policy: str = "carry") -> DataFrame:
    """Feature columns without nulls: ``carry`` takes the last value, else the next, else zero; ``median`` that of the series,
    else zero. Binary columns get zero."""
    rest = [c for c in columns if c not in binary]
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in binary}
    if policy == "median":
        rows = with_statistics(df, keys, {f"_s_{c}": F.median(c) for c in rest})
        return rows.withColumns(flags | {c: F.coalesce(F.col(c), F.col(f"_s_{c}"), F.lit(0)) for c in rest}).select(*df.columns)
    if policy != "carry":
        raise ValueError(f"unknown policy: {policy}")
    back, ahead = so_far(keys, time), from_here(keys, time)
    return df.withColumns(flags | {c: F.coalesce(F.last(c, True).over(back), F.last(c, True).over(ahead), F.lit(0)) for c in rest})
