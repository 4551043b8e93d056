"""Joins and set operations between series, calendars and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(bars: DataFrame, events: DataFrame, keys: Sequence[str], at: str, event_at: str, payload: Sequence[str]) -> DataFrame:
    """Each bar with the latest event at or before it (prev_*) and the first one after it (next_*), null if there is none.

    Both sides go through one shuffle by key as a union ordered by time, not through a range join: O(n log n) whatever
    the number of events. Of events at one time the greatest counts. Payload columns must not be named like bar columns.
    """
    item = F.struct(F.col(event_at).alias("at"), *payload)
    left = bars.withColumns({"_t": F.col(at), "_kind": F.lit(1), "_event": F.lit(None).cast(events.select(item.alias("x")).schema["x"].dataType)})
    right = events.select(*[F.col(k) for k in keys], F.col(event_at).alias("_t"), F.lit(0).alias("_kind"), item.alias("_event"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_t", "_kind", "_event")
    before = F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # read backwards: a frame that ends with the partition would be read anew for every row
    backwards = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_kind"), F.desc("_event"))
    after = F.last("_event", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumns({"_before": before, "_after": after}).where("_kind = 1")
    ends = {"prev": "_before", "next": "_after"}
    return found.select(*bars.columns, *[F.col(f"{x}.{c}").alias(f"{name}_{c}") for name, x in ends.items() for c in ("at", *payload)])


def near_events(bars: DataFrame, events: DataFrame, at: str, event_at: str, label: str, before_days: int, after_days: int) -> DataFrame:
    """Bars with the label of the event they lie around; the later event wins, null if there is none.

    The window is cut into days: bars equi-join the exploded days of the events, so no nested loop over all pairs.
    """
    days = F.sequence(F.date_sub(F.to_date(event_at), before_days), F.date_add(F.to_date(event_at), after_days - 1))
    exploded = events.select(F.explode(days).alias("_day"), F.to_date(event_at).alias("_event"), F.col(label).alias("_label"))
    latest = exploded.groupBy("_day").agg(F.max(F.struct("_event", "_label")).alias("_e"))
    joined = bars.join(latest, F.to_date(at) == F.col("_day"), "left")
    return joined.select(*bars.columns, F.col("_e._label").alias("near_label"), F.datediff(F.to_date(at), F.col("_e._event")).alias("days_from_event"))


def aligned(bars: DataFrame, step_seconds: int) -> DataFrame:
    """All symbols on the grid of their common time span, closes interpolated along time and extended at the ends.

    The common span is two numbers; the grid itself is exploded from them per symbol.
    """
    base = bars.select("symbol", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', open_time)").alias("s"), "close")
    spans = base.groupBy("symbol").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    common = spans.agg(F.max("lo").alias("from"), F.min("hi").alias("to"))
    slots = spans.crossJoin(F.broadcast(common)).where("from <= to").select("symbol", F.explode(F.sequence("from", "to", F.lit(step_seconds).cast("long"))).alias("s"))
    both = slots.join(base, ["symbol", "s"], "full").withColumn("known", F.when(F.col("close").isNotNull(), F.col("s")))
    back = Window.partitionBy("symbol").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("symbol").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(
        "symbol", "s", F.last("close", True).over(back).alias("v0"), F.last("close", True).over(ahead).alias("v1"), F.last("known", True).over(back).alias("t0"), F.last("known", True).over(ahead).alias("t1")
    )
    line = F.when(F.col("t1") > F.col("t0"), F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("s") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    on_grid = both.join(slots, ["symbol", "s"], "left_semi")
    return on_grid.select("symbol", F.timestamp_add("SECOND", F.col("s"), F.expr("timestamp_ntz'1970-01-01 00:00:00'")).alias("open_time"), F.coalesce(line, "v0", "v1").alias("close"))


def latest_versions(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the greatest version of each key: an upsert's outcome. Combined on the map side."""
    rest = [c for c in rows.columns if c not in (*keys, *version)]
    best = F.max(F.struct(*version, *rest)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*version, *rest)])


def upserted(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], partial: bool = False, version: Sequence[str] = ()) -> DataFrame:
    """stored with incoming merged in: incoming rows replace those of their key, or with ``partial`` only where not null.

    Of incoming rows with one key the greatest ``version`` counts, then the greatest values.
    """
    a, b = stored.withColumn("_side", F.lit(0)), incoming.withColumn("_side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    rest = [c for c in stored.columns if c not in keys]
    if not partial:
        return latest_versions(both, keys, ["_side", *version]).select(*stored.columns)
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct("_side", *version, c))
    newest = [F.max_by(c, order(c)).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*newest).select(*stored.columns)


def first_wins(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)])


def retained(rows: DataFrame, at: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before the newest one."""
    newest = rows.agg(F.max(at).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.col(at) > F.col("_newest") - F.make_dt_interval(days=F.lit(days))).drop("_newest")
