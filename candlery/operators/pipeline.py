"""Pipelines of named steps, and the feature frame that models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlery.operators.features import CATALOG

Step = Callable[..., DataFrame]
STEPS: dict[str, Step] = {}
#: Catalogue entries that make up the full feature frame, in order.
GROUPS = ("w01_lagged", "w08_returns", "w09_volumes", "w14_microstructure", "t01_sma", "t05_bollinger", "t10_momentum", "k01_candle_patterns", "v01_volatility", "w04_calendar", "w11_ratios", "w12_crossover", "c01_custom", "v05_volatility_features")
KEY = ["symbol", "open_time"]


def step(name: str) -> Callable[[Step], Step]:
    """Registers a function of a DataFrame under a name that pipelines can call."""

    def add(f: Step) -> Step:
        STEPS[name] = f
        return f

    return add


def run_steps(df: DataFrame, steps: Sequence[str | tuple[str, dict]]) -> DataFrame:
    """Applies named steps in order as one lazy plan; an unknown name raises before anything is built."""
    calls = [(s, {}) if isinstance(s, str) else s for s in steps]
    unknown = [n for n, _ in calls if n not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    return reduce(lambda d, call: STEPS[call[0]](d, **call[1]), calls, df)


@step("drop_duplicates")
def drop_duplicates(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row per symbol and time: the first by ``order``, or by all columns where rows have no order of their own."""
    rest = [c for c in df.columns if c not in (*KEY, order)]
    first = [order] if order else []
    return df.groupBy(*KEY).agg(F.min(F.struct(*first, *rest)).alias("r")).select(*KEY, *[F.col(f"r.{c}").alias(c) for c in (*first, *rest)])


@step("time_range")
def time_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col("open_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


@step("repair")
def repair(df: DataFrame) -> DataFrame:
    clean = CATALOG["f05_repaired"].apply(df, keep=("open",))
    return clean.select(*KEY, "open", F.col("high_clean").alias("high"), F.col("low_clean").alias("low"), F.col("close_clean").alias("close"), F.col("volume_clean").alias("volume"))


@step("outlier_flags")
def outlier_flags(df: DataFrame, methods: Sequence[str] = ("o02_robust_outliers", "o05_domain_rules")) -> DataFrame:
    """The bars with is_outlier: 1 if any method flags them; one chain of windows, no join."""
    flagged, names = df, []
    for method in methods:
        flagged, own = _extended(flagged, method)
        names += [c for c in own if c.startswith("anomaly")]
    return flagged.select(*df.columns, F.greatest(*names, F.lit(0)).alias("is_outlier"))


def _extended(df: DataFrame, group: str) -> tuple[DataFrame, list[str]]:
    """The frame with a group's columns beside its own; columns that it has already are left as they are."""
    plan = CATALOG[group]
    kept = tuple(c for c in df.columns if c not in KEY)
    taken = {c for stage in plan.stages for c in stage} & set(kept)
    # stages see what the group itself makes; a column of the same name waits under another one
    hidden = df.select(*[F.col(c).alias(f"_held_{c}") if c in taken else F.col(c) for c in df.columns])
    made = plan.apply(hidden, keep=tuple(f"_held_{c}" if c in taken else c for c in kept))
    own = [c for c in made.columns if c not in (*KEY, *kept) and not c.startswith("_held_") and c not in taken]
    return made.select(*KEY, *[F.col(f"_held_{c}").alias(c) if c in taken else F.col(c) for c in kept], *own), own


@step("features")
def feature_frame(df: DataFrame, groups: Sequence[str] = GROUPS, target: str | None = "target_return") -> DataFrame:
    """All columns of the groups, computed in one chain over the same windows, with the target; rows without one left out."""
    frame = df
    for group in groups:
        frame, _ = _extended(frame, group)
    if target:
        names = frame.columns
        frame, _ = _extended(frame, "w10_targets")
        frame = frame.select(*names, target).where(F.col(target).isNotNull())
    return frame
