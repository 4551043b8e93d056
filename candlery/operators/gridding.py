"""Irregular readings onto a regular grid by validity intervals (problem 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlery.functions.timeaxis import floor_div, timeframe_label, utc_text
from candlery.operators.bars import BLOCK_PERIODS, SERIES, feed, placed_bars

#: Cells made by one explode of a gap; longer gaps are cut into several rows first.
GAP_CHUNK = 4_096


def _with_next(readings: DataFrame, keys: Sequence[str], block: str, at: str) -> DataFrame:
    """Adds nxt, the next reading's place in the series. Only block edges are ordered along a whole series."""
    inside = Window.partitionBy(*keys, block).orderBy(at)
    edges = readings.groupBy(*keys, block).agg(F.min(at).alias("edge"))
    edges = edges.select(*keys, block, F.lead("edge").over(Window.partitionBy(*keys).orderBy(block)).alias("edge"))
    joined = readings.join(edges, [*keys, block], "inner")
    return joined.withColumn("nxt", F.coalesce(F.lead(at).over(inside), F.col("edge"))).drop("edge")


def grid_cells(readings: DataFrame, keys: Sequence[str], hold: float = 1.0) -> DataFrame:
    """Readings as a step function, intersected with the cells of a grid.

    ``readings``: the key columns (not null), at (place on the time axis in cells, any fraction; one reading per place) and value.
    A reading is valid from its place until the next reading, at most ``hold`` cells, and not at all if its value is
    null. Result: keys, cell, twa (time-weighted average over the covered part, null if none), coverage (covered fraction
    of the cell), n (readings that begin in the cell): one row for each cell from the first to the last reading's.
    """
    readings = readings.select(*keys, F.col("at").cast("double").alias("at"), F.col("value").cast("double").alias("value"))
    readings = readings.withColumn("block", F.coalesce(F.floor(F.col("at") / BLOCK_PERIODS), F.lit(0).cast("long")))
    steps = _with_next(readings, keys, "block", "at")
    first = F.floor(F.col("at"))
    # the last cell before that of the next reading, and that cell too if the next reading begins inside it
    last = F.coalesce(F.greatest(first, F.ceil(F.col("nxt")) - 1), first)
    until = F.when(F.col("value").isNotNull(), F.least(F.coalesce(F.col("nxt"), F.col("at") + hold), F.col("at") + hold)).otherwise(F.col("at"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("hi") - F.col("lo")) / GAP_CHUNK))
    pieces = (
        steps.withColumns({"lo": first, "hi": last, "until": until})
        .withColumn("chunk", F.explode(chunks))
        .withColumn("from", F.col("lo") + F.col("chunk") * GAP_CHUNK)
        .withColumn("cell", F.explode(F.sequence(F.col("from"), F.least(F.col("hi"), F.col("from") + GAP_CHUNK - 1))))
    )
    overlap = F.greatest(F.lit(0.0), F.least(F.col("until"), F.col("cell") + 1.0) - F.greatest(F.col("at"), F.col("cell").cast("double")))
    return (
        pieces.select(*keys, "cell", "value", overlap.alias("w"), (F.col("cell") == F.col("lo")).alias("begins"))
        .groupBy(*keys, "cell")
        .agg(
            F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum(F.when(F.col("value").isNotNull(), F.col("w")))).alias("twa"),
            F.least(F.lit(1.0), F.sum("w")).alias("coverage"),
            F.count_if("begins").alias("n"),
        )
    )


def snapped_closes(bars: DataFrame) -> DataFrame:
    """feed_id, tf, at (period number) and value: of the rows of a period that give a close, the latest to arrive."""
    rows = placed_bars(bars, "close").withColumn("has", F.col("close").isNotNull())
    best = F.max(F.struct("has", "arrival", "id", "close"))
    return rows.groupBy(*SERIES, "per").agg(best.alias("b")).select(*SERIES, F.col("per").alias("at"), F.col("b.close").alias("value"))


def regular_closes(bars: DataFrame) -> DataFrame:
    """Exactly one row per period of each series, from its first bar to its last.

    feed_id, timeframe, period_start, close (null where no row gives one), close_filled (the last close before, through
    the gap), coverage (0 or 1), status ('observed', 'filled', 'missing': nothing before to fill from).
    """
    cells = grid_cells(snapped_closes(bars), SERIES)
    cells = cells.withColumn("block", floor_div(F.col("cell"), BLOCK_PERIODS))
    inside = Window.partitionBy(*SERIES, "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    # every block of a series has cells; blocks without a close carry on the one before
    all_blocks = cells.groupBy(*SERIES, "block").agg(F.max_by(F.when(F.col("coverage") > 0, F.col("twa")), F.when(F.col("coverage") > 0, F.col("cell"))).alias("tail"))
    ahead = Window.partitionBy(*SERIES).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_blocks.select(*SERIES, "block", F.last("tail", ignorenulls=True).over(ahead).alias("carry"))
    full = cells.join(carried, [*SERIES, "block"], "inner")
    observed = F.when(F.col("coverage") > 0, F.col("twa"))
    filled = F.coalesce(F.last(observed, ignorenulls=True).over(inside), F.col("carry"))
    return full.select(
        feed(),
        timeframe_label(F.col("tf")).alias("timeframe"),
        utc_text(F.col("cell") * F.col("tf") * 1_000_000).alias("period_start"),
        observed.alias("close"),
        filled.alias("close_filled"),
        F.col("coverage"),
        F.when(F.col("coverage") > 0, "observed").when(filled.isNotNull(), "filled").otherwise("missing").alias("status"),
    )


def uncovered_periods(bars: DataFrame) -> DataFrame:
    """feed_id, timeframe, period_start of the periods inside a series that no row's close covers."""
    cells = grid_cells(snapped_closes(bars), SERIES).where("coverage = 0")
    return cells.select(feed(), timeframe_label(F.col("tf")).alias("timeframe"), utc_text(F.col("cell") * F.col("tf") * 1_000_000).alias("period_start"))
