"""Bars as delivered, on the grid of their timeframe: one row per series and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlery.functions.timeaxis import floor_div, micros, timeframe_seconds

SERIES = ["feed_id", "tf"]
#: Periods in one time block; a block, never a whole series, is what one task sorts.
BLOCK_PERIODS = 16_384
#: Stands for a null feed_id inside the operators, so that series keys are plain equi-join keys.
NO_FEED = "\u0000"


def placed_bars(bars: DataFrame, *values: str) -> DataFrame:
    """feed_id, tf (seconds), per (period number), arrival, id and the named value columns of each delivered row.

    A row goes to the period whose start is nearest to open_time (a tie to the later one). Rows without a known
    timeframe or open_time are on no grid and are left out; a null feed_id is a series of its own. Other columns of the
    input are not read, so their names can't clash.
    """
    seen = bars.select(
        F.coalesce(F.col("feed_id"), F.lit(NO_FEED)).alias("feed_id"),
        F.coalesce(timeframe_seconds(F.col("timeframe")), F.lit(0).cast("long")).alias("tf"),
        micros(bars, "open_time").alias("at_us"),
        micros(bars, "created_at").alias("arrival"),
        "id",
        *values,
    ).where("tf > 0 and at_us is not null")
    length = F.col("tf") * 1_000_000
    return seen.withColumn("per", floor_div(F.col("at_us") + F.expr("tf * 500000"), length)).drop("at_us")


def latest_bars(bars: DataFrame, *values: str) -> DataFrame:
    """Of several rows of a series in one period, the one that arrived last (then the highest id, then the largest values).

    The maximum of a struct is combined on the map side, so a period delivered millions of times is one row per task
    before the shuffle, and the shuffle key has the period in it: a series of any size is spread over all tasks.
    """
    placed = placed_bars(bars, *values)
    return (
        placed.groupBy(*SERIES, "per")
        .agg(F.max(F.struct("arrival", "id", *values)).alias("bar"))
        .select(*SERIES, "per", "bar.id", *[f"bar.{v}" for v in values])
    )


def feed() -> Column:
    """feed_id for a result, null again where it was null."""
    return F.nullif(F.col("feed_id"), F.lit(NO_FEED)).alias("feed_id")


def edged_blocks(rows: DataFrame, edge: int, carried: str) -> DataFrame:
    """Cut each series into time blocks, each with the ``edge`` bars before it and behind it, whatever gaps lie between.

    Adds blk, own (false for those copies) and seed: on the first bar of a block the last value of ``carried`` that any
    bar before the block has. Only the edges of blocks are ordered along a series, so no task ever holds a whole one,
    and the bars themselves move once, to their blocks.
    """
    rows = rows.withColumn("blk", floor_div(F.col("per"), BLOCK_PERIODS))
    inside = Window.partitionBy(*SERIES, "blk")
    spots = rows.select(*SERIES, "blk", "per", carried).withColumns(
        {
            "place": F.row_number().over(inside.orderBy("per")),
            "size": F.count("*").over(inside),
            "valued": F.max(F.when(F.col(carried).isNotNull(), F.col("per"))).over(inside),
        }
    )
    edges = spots.where(f"place <= {edge} or place > size - {edge} or per = valued")
    along = Window.partitionBy(*SERIES).orderBy("per")
    near = F.array_union(*[F.collect_set("blk").over(along.rowsBetween(*b)) for b in ((-edge, -1), (1, edge))])
    before = F.last(carried, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumns({"near": near, "before": before})
    copies = F.filter("near", lambda b: b != F.col("blk"))
    edges = edges.select(*SERIES, "per", copies.alias("copies"), F.when(F.col("place") == 1, F.col("before")).alias("seed"))
    edges = edges.where("size(copies) > 0 or seed is not null")
    home = rows.withColumnRenamed("blk", "home").join(edges, [*SERIES, "per"], "left")
    blocks = F.concat(F.array("home"), F.coalesce("copies", F.array().cast("array<bigint>")))
    placed = home.withColumn("blk", F.explode(blocks)).withColumn("own", F.col("blk") == F.col("home"))
    return placed.withColumn("seed", F.when(F.col("own"), F.col("seed"))).drop("home", "copies")
