"""Implausible readings of bars, measured against their own series (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlery.functions.timeaxis import floor_div
from candlery.operators.bars import SERIES, edged_blocks, latest_bars
from candlery.session import ensure_checkpoint_dir

#: Bars on either side of a block that its windows look at.
EDGE = 5
#: Bars on either side of the running median that is the trend; outlasts excursions of up to this many bars.
REACH = 3
#: Share of a series that may be outliers, and the level, of the generalised extreme studentised deviate test.
OUTLIER_SHARE, ALPHA = 0.1, 0.05
#: Residuals under so many robust deviations can't be outliers (the least limit is above two) and are only summed up.
NEAR = 2.0
#: Accuracy of the mergeable quantile sketches: ranks are off by at most 1/ACCURACY.
ACCURACY = 10_000
#: Steps a doubling of the deviation in which candidates are ordered apart, so that no task orders those of a series.
STEPS = 16


def with_esd_limit(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Adds esd_limit: that of the generalised ESD test that finds ``left`` values not yet removed, in their deviations.

    The t quantile comes from the normal one (rational approximation of the tail) by a Cornish-Fisher expansion. Each step
    is a column of its own: as one expression it would be copied into itself hundreds of times.
    """
    left, u, z, f, t = (F.col(c) for c in ("_left", "_u", "_z", "_freedom", "_t"))
    rows = rows.withColumn("_left", F.greatest(F.lit(1.0), F.col("left").cast("double")))
    rows = rows.withColumns({"_u": F.sqrt(-2 * F.ln(alpha / (2 * left))), "_freedom": F.greatest(F.lit(1.0), left - 2)})
    rows = rows.withColumn("_z", u - (2.515517 + u * (0.802853 + u * 0.010328)) / (1 + u * (1.432788 + u * (0.189269 + u * 0.001308))))
    z2 = z * z
    rows = rows.withColumn("_t", z * (1 + (z2 + 1) / (4 * f) + (z2 * (5 * z2 + 16) + 3) / (96 * f * f)))
    return rows.withColumn("esd_limit", (left - 1) * t / F.sqrt((f + t * t) * left)).drop("_left", "_u", "_z", "_freedom", "_t")


def season_length(tf: Column) -> Column:
    """Periods of one season: a day for bars shorter than that, a week for daily ones, else none."""
    return F.when(tf < 3600, F.lit(24)).when(tf < 86400, F.floor(86400 / tf)).when(tf == 86400, F.lit(7)).otherwise(F.lit(1))


def _phase() -> Column:
    # bars shorter than an hour share the phase of their hour
    step = F.greatest(F.lit(1), F.floor(3600 / F.col("tf")))
    return F.pmod(floor_div(F.col("per"), step), F.greatest(F.lit(1), season_length(F.col("tf"))))


def _running_median(name: str, w: Window) -> Column:
    around = [F.lag(name, i).over(w) for i in range(REACH, 0, -1)] + [F.col(name)] + [F.lead(name, i).over(w) for i in range(1, REACH + 1)]
    ordered = F.sort_array(F.array_compact(F.array(*around)))
    return F.try_element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)


def _features(bars: DataFrame) -> DataFrame:
    """Bars in blocks with trend, neighbours and the two checks that need no statistics."""
    w = Window.partitionBy(*SERIES, "blk").orderBy("per")
    rows = edged_blocks(latest_bars(bars, "open", "high", "low", "close", "volume").withColumn("price", F.when(F.col("close") > 0, F.col("close"))), EDGE, "price")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    impossible = F.coalesce(F.least(*prices) <= 0, F.lit(False))
    impossible |= F.coalesce(F.col("volume") < 0, F.lit(False)) | F.coalesce(F.col("high") < F.col("low"), F.lit(False))
    for c in ("open", "close"):
        impossible |= F.coalesce((F.col(c) < F.col("low")) | (F.col(c) > F.col("high")), F.lit(False))
    readings = {"top": F.greatest("high", "low", "close"), "bottom": F.least("high", "low", "close")}
    rows = rows.withColumns({"impossible": impossible, "phase": _phase().cast("long")} | readings).drop("open", "high", "low")

    # runs: same_x is true if this bar and the five before all trade at the same value; it then marks those six
    six, ahead = w.rowsBetween(-5, 0), w.rowsBetween(0, 5)
    traded = F.count_if(F.col("volume") > 0).over(six) == 6
    for c in ("close", "volume"):
        rows = rows.withColumn(f"run_{c}", traded & (F.count(c).over(six) == 6) & (F.min(c).over(six) == F.max(c).over(six)))
    stuck = F.max("run_close").over(ahead) | F.max("run_volume").over(ahead)

    # the last price before a bar, however many bars without one lie between: within the block, else from before it
    before = F.coalesce(
        F.last("price", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.last("seed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )
    trend = _running_median("price", w)
    rows = rows.withColumns({"stuck": F.coalesce(stuck, F.lit(False)), "move": F.abs(F.col("price") - before), "trend": trend}).drop("run_close", "run_volume", "seed", "close")
    rows = rows.withColumn("off", F.col("price") - F.col("trend"))
    near = {f"{c}_{s}{i}": f(c, i).over(w) for c in ("price", "off") for s, f in (("b", F.lag), ("a", F.lead)) for i in range(1, REACH + 1)}
    return rows.withColumns(near).where("own")


def _farthest(level: Column) -> Column:
    """Of high, low and close less ``level``, the one farthest from zero, with its sign."""
    up, down = F.col("top") - level, F.col("bottom") - level
    return F.when(up >= -down, up).otherwise(down)


def series_statistics(rows: DataFrame) -> DataFrame:
    """One row per series: bars, blocks, typical move and volume, seasonal medians by phase and residual scales.

    All of it from quantile sketches, which are merged before the shuffle, so a series of any size costs each task the
    same. The scale of prices is the median distance of a bar's farthest reading from the trend, that of volumes the mean
    interquartile range within phases, both as standard deviations.
    """
    quarters = F.lit([0.25, 0.5, 0.75])
    whole, seasonal = F.col("phase") < 0, F.col("phase") >= 0
    sets = rows.select(
        *SERIES, "blk", F.explode(F.array(F.col("phase"), F.lit(-1).cast("long"))).alias("phase"), "off", "move", "volume", F.abs(_farthest(F.col("trend"))).alias("reach")
    )
    each = sets.groupBy(*SERIES, "phase").agg(
        F.count("*").alias("n"),
        F.min("blk").alias("first_blk"),
        F.max("blk").alias("last_blk"),
        F.percentile_approx(F.when(seasonal, F.col("off")), 0.5, ACCURACY).alias("off"),
        F.percentile_approx(F.when(seasonal, F.col("volume")), quarters, ACCURACY).alias("volumes"),
        F.percentile_approx(F.when(whole, F.col("move")), 0.5, ACCURACY).alias("move"),
        F.percentile_approx(F.when(whole, F.col("reach")), 0.5, ACCURACY).alias("reach"),
        F.percentile_approx(F.when(whole & (F.col("volume") > 0), F.col("volume")), 0.5, ACCURACY).alias("volume"),
    )
    n = F.when(seasonal, F.col("n"))
    return each.groupBy(*SERIES).agg(
        F.min("first_blk").alias("first_blk"),
        F.max("last_blk").alias("last_blk"),
        F.max("move").alias("typical_move"),
        F.max("volume").alias("typical_volume"),
        (F.max("reach") / 0.6745).alias("price_scale"),
        (F.try_divide(F.sum(n * (F.col("volumes")[2] - F.col("volumes")[0])), F.sum(n)) / 1.349).alias("volume_scale"),
        F.map_from_entries(F.array_agg(F.when(seasonal, F.struct("phase", "off")))).alias("price_season"),
        F.map_from_entries(F.array_agg(F.when(seasonal, F.struct("phase", F.col("volumes")[1])))).alias("volume_season"),
    )


def _deviation(y: Column, scale: Column) -> Column:
    """|y| in robust deviations; beyond all of them where the series has no spread but this bar leaves it."""
    return F.when(scale > 0, F.abs(y) / scale).when(F.abs(y) > 0, F.lit(1e9))


def _residuals(bars: DataFrame, spike_moves: float, spike_volumes: float) -> DataFrame:
    """Residuals of the decomposition: one row for each bar that may be an outlier or fails a plain check, and one for
    each block with the sums of all its other residuals."""
    rows = _features(bars)
    stats = series_statistics(rows)
    # one copy of a series' row for each of its blocks: joined where the blocks lie, a large series has many
    stats = stats.withColumn("blk", F.explode(F.sequence("first_blk", "last_blk"))).withColumnRenamed("typical_volume", "usual_volume")
    scored = rows.join(stats, [*SERIES, "blk"], "inner")
    season = F.coalesce(F.try_element_at("price_season", F.col("phase")), F.lit(0.0))
    calm = lambda s, i: F.when(F.abs(F.col(f"off_{s}{i}")) < spike_moves / 2 * F.col("typical_move"), F.col(f"price_{s}{i}"))
    # columns of their own, so that each is computed once
    scored = scored.withColumns(
        {"level": F.col("trend") + season, "y_volume": F.col("volume") - F.try_element_at("volume_season", F.col("phase")), "far": spike_moves * F.col("typical_move")}
        | {name: F.coalesce(*[calm(s, i) for i in range(1, REACH + 1)]) for name, s in (("before", "b"), ("after", "a"))}
    )
    scored = scored.withColumns({"upper": F.greatest("before", "after") + F.col("far"), "lower": F.least("before", "after") - F.col("far"), "both": F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("typical_move") > 0)})
    scored = scored.withColumn("y_price", _farthest(F.col("level")))
    spike = F.coalesce(F.col("both") & ((F.col("top") >= F.col("upper")) | (F.col("bottom") <= F.col("lower"))), F.lit(False))
    loud = F.coalesce(F.col("volume") >= spike_volumes * F.col("usual_volume"), F.lit(False))
    scored = scored.select(
        *SERIES, "blk", "per", "id", "impossible", "stuck", spike.alias("far"), loud.alias("loud"), "y_price", "y_volume", "price_scale",
        _deviation(F.col("y_price"), F.col("price_scale")).alias("z_price"), _deviation(F.col("y_volume"), F.col("volume_scale")).alias("z_volume"),
    )
    measures, near = {}, {m: F.coalesce(F.col(f"z_{m}") < NEAR, F.lit(True)) for m in ("price", "volume")}
    scored = scored.withColumns({f"bulk_{m}": F.when(near[m], F.col(f"y_{m}")) for m in near} | {f"{c}_{m}": F.when(~near[m], F.col(f"{c}_{m}")) for m in near for c in "yz"} | {"score": F.col("y_price") / F.when(F.col("price_scale") > 0, F.col("price_scale"))})
    for m in near:
        bulk = F.col(f"bulk_{m}")
        measures |= {f"n_{m}": F.count(bulk), f"s_{m}": F.sum(bulk), f"q_{m}": F.sum(bulk * bulk), f"y_{m}": F.sum(f"y_{m}"), f"z_{m}": F.sum(f"z_{m}")}  # one value, if any
    kept = F.col("impossible") | F.col("stuck") | F.coalesce(F.greatest("z_price", "z_volume").isNotNull(), F.lit(False))
    checks = {c: F.max(F.col(c).cast("int")).cast("boolean") for c in ("impossible", "stuck", "far", "loud")} | {"id": F.max("id"), "residual": F.sum("score")}
    # grouped where the blocks lie: what isn't kept becomes one row a block before anything moves
    return scored.groupBy(*SERIES, "blk", F.when(kept, F.col("per")).alias("per")).agg(*[x.alias(k) for k, x in (measures | checks).items()])


def esd_bounds(residuals: DataFrame, share: float = OUTLIER_SHARE, alpha: float = ALPHA) -> DataFrame:
    """feed_id, tf, price_bound, volume_bound: the least deviation of a bar that the generalised ESD procedure reports.

    Values are removed one by one, the farthest first, up to ``share`` of the series. With i - 1 removed, R_i is the next
    one's distance from the mean of those left in their standard deviations; outliers are all up to the last i with R_i
    beyond its limit. Sums of those left come from sums by steps of the deviation below and running sums within a step,
    both from the smallest value up, so that large outliers cost no precision and no task orders a whole series.
    """
    entries = [F.struct(F.lit(m).alias("m"), *[F.col(f"{c}_{m}").alias(c) for c in "yznsq"]) for m in ("price", "volume")]
    values = residuals.select(*SERIES, "per", F.explode(F.array(*entries)).alias("x")).select(*SERIES, "per", "x.*")
    step = F.coalesce(F.floor(F.log2("z") * STEPS), F.lit(-1).cast("long"))
    values = values.withColumn("step", step).where("z is not null or n > 0")
    keys = [*SERIES, "m"]
    y = F.col("y")
    steps = values.groupBy(*keys, "step").agg((F.sum("n") + F.count("z")).alias("n"), F.sum(F.coalesce("s", F.lit(0.0)) + F.coalesce(y, F.lit(0.0))).alias("s"), F.sum(F.coalesce("q", F.lit(0.0)) + F.coalesce(y * y, F.lit(0.0))).alias("q"))
    below = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*keys, "step", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"below_{c}") for c in "nsq"], F.sum("n").over(Window.partitionBy(*keys)).alias("n_all"))
    candidates = values.where("z is not null").select(*keys, "step", "per", "z", "y").join(steps, [*keys, "step"])
    up = Window.partitionBy(*keys, "step").orderBy("z", "per").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("below_n") + F.row_number().over(Window.partitionBy(*keys, "step").orderBy("z", "per"))
    candidates = candidates.withColumns({"left": left, "sum": F.col("below_s") + F.sum("y").over(up), "squares": F.col("below_q") + F.sum(y * y).over(up)})
    candidates = with_esd_limit(candidates.withColumn("mean", F.col("sum") / F.col("left")), alpha)
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("squares") - F.col("sum") * F.col("mean"), F.col("left") - 1)))
    removed = F.col("n_all") - F.col("left") + 1
    reported = (removed <= F.greatest(F.lit(1), F.floor(F.col("n_all") * share))) & (F.abs(y - F.col("mean")) > F.col("esd_limit") * deviation)
    least = candidates.where(reported).groupBy(*SERIES)
    return least.agg(*[F.min(F.when(F.col("m") == m, F.col("z"))).alias(f"{m}_bound") for m in ("price", "volume")])


def flagged_bars(bars: DataFrame, spike_moves: float = 18.0, spike_volumes: float = 10.0, share: float = OUTLIER_SHARE) -> DataFrame:
    """Bars (latest delivery of each period) with which something is wrong, measured against their own series.

    Columns: id, feed_id, tf, per, impossible, stuck, outlier, volume_outlier, spike, volume_spike, residual (of the reading
    farthest from trend and season, in robust deviations). impossible and stuck are range and constant-run checks. Outliers are what
    the generalised ESD procedure reports among the residuals of a robust decomposition: prices less a running median
    and seasonal medians by phase, volumes less seasonal medians (a running one would follow a burst). A spike is an outlier
    that also meets the exact rule: high, low or close at least ``spike_moves`` typical moves off the closes before and
    after, on the same side of both; volume at least ``spike_volumes`` times the typical one. Those closes are the nearest
    within three bars that are not themselves part of an excursion, so a move that the series keeps is none. Null fields
    fail no check; a null close counts as no close. Bars that pass all checks have no row.
    """
    ensure_checkpoint_dir(bars.sparkSession)
    residuals = _residuals(bars, spike_moves, spike_volumes).checkpoint()
    judged = residuals.where("per is not null").join(esd_bounds(residuals, share), [*SERIES], "left")
    for m, name in (("price", "outlier"), ("volume", "volume_outlier")):
        judged = judged.withColumn(name, F.coalesce(F.col(f"z_{m}") >= F.col(f"{m}_bound"), F.lit(False)))
    found = judged.select("id", *SERIES, "per", "impossible", "stuck", "outlier", "volume_outlier", (F.col("outlier") & F.col("far")).alias("spike"), (F.col("volume_outlier") & F.col("loud")).alias("volume_spike"), "residual")
    return found.where("impossible or stuck or outlier or volume_outlier")


def implausible_ids(bars: DataFrame) -> DataFrame:
    """id of the counting bars that fail any check."""
    return flagged_bars(bars).where("impossible or stuck or spike or volume_spike").select("id")
