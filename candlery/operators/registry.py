"""Named, versioned result tables with natural keys: forecasts, models, matrices, indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlery.operators.joins import latest_versions

# Natural keys of the result tables.
KEYS = {
    "correlation_pairs": ("symbol_a", "symbol_b", "kind", "timeframe"), "volatility_metrics": ("symbol", "timeframe", "open_time"), "market_cycles": ("symbol", "cycle_no"),
    "model_metadata": ("model_key",), "model_metrics": ("model_key", "metric", "test_date"), "model_forecasts": ("model_key", "forecast_date"), "predictions": ("model_key", "symbol", "timeframe", "target_at"),
    "technical_indicators": ("symbol", "timeframe", "open_time", "indicator"), "news_articles": ("link",), "sequences": ("symbol", "timeframe", "sequence_id", "position"),
    "beta_series": ("symbol", "market", "open_time"), "regime_correlations": ("regime", "symbol_a", "symbol_b"), "leading_indicators": ("target", "candidate", "lag"), "cycle_similarity": ("symbol", "bars_back"),
    "turning_points": ("symbol", "open_time", "kind"), "volatility_models": ("symbol", "model"), "trend_analysis": ("symbol", "timeframe"), "topics": ("topic",), "article_topics": ("link", "topic"),
    "event_log": ("logged_at", "component", "message"), "model_files": ("model_key",),
}


class Registry:
    """Tables in a shared folder. A save appends a version; reading gives the latest row of each key."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, table: str, rows: DataFrame, version: int) -> None:
        """Writes rows as one version; saving a version again replaces it, so a retried job leaves no double."""
        missing = set(KEYS[table]) - set(rows.columns)
        if missing:
            raise ValueError(f"{table} needs the columns {sorted(missing)}")
        rows.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self.folder}/{table}/version={version}")

    def latest(self, table: str, **equal: object) -> DataFrame:
        """The latest version of every key, filtered on the keys before versions are compared."""
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}")
        for name, value in equal.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return latest_versions(rows, KEYS[table], ["version"])

    def history(self, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}")

    def top_pairs(self, n: int = 10) -> DataFrame:
        """The pairs with the strongest correlation of either sign."""
        return self.latest("correlation_pairs").orderBy(F.desc(F.abs("corr")), *KEYS["correlation_pairs"]).limit(n)

    def active(self, table: str, end: str = "end_at") -> DataFrame:
        """The latest rows that aren't closed: those without an end."""
        return self.latest(table).where(F.col(end).isNull())

    def save_file(self, key: str, path: str, version: int) -> None:
        """A file of a fitted model as one row of bytes under its key."""
        rows = self.spark.read.format("binaryFile").load(path).select(F.lit(key).alias("model_key"), "path", "content", "length")
        self.save("model_files", rows, version)

    def log(self, component: str, level: str, message: str, version: int) -> None:
        """One row of the event log, with the time it is written."""
        row = self.spark.createDataFrame([(component, level, message)], "component string, level string, message string")
        self.save("event_log", row.withColumn("logged_at", F.current_timestamp()), version)

    def bootstrap(self, schemas: dict[str, str]) -> list[str]:
        """Writes an empty version 0 of each table that has none yet, so that readers find its columns; the tables made."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        made = []
        for table, schema in schemas.items():
            at = path(f"{self.folder}/{table}")
            if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                self.save(table, self.spark.createDataFrame([], schema), 0)
                made.append(table)
        return made

    def with_actuals(self, actual: DataFrame) -> DataFrame:
        """Predictions joined to what came (symbol, target_at, actual), with the absolute error; open ones keep nulls."""
        joined = self.latest("predictions").join(actual, ["symbol", "target_at"], "left")
        return joined.withColumn("abs_error", F.abs(F.col("predicted") - F.col("actual")))


def analysis_json(rows: DataFrame, content: str, keep: int = 500) -> DataFrame:
    """One JSON text per row, its content field cut to ``keep`` characters."""
    return rows.select(F.to_json(F.struct(*[F.substring(c, 1, keep).alias(c) if c == content else F.col(c) for c in rows.columns])).alias("json"))


def parsed_klines(messages: DataFrame, column: str = "json") -> DataFrame:
    """Candles from the JSON of a kline stream: typed, times from milliseconds, closed flag; broken messages are left out."""
    # names differ by case alone (t and T), which a struct can't hold
    parsed = messages.select(F.from_json(F.col(column), "s string, k map<string, string>").alias("m"))
    field = lambda name, kind: F.col("m.k")[name].try_cast(kind)
    rows = parsed.where(field("t", "long").isNotNull())
    number = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "quote_asset_volume": "q", "taker_buy_base_volume": "V", "taker_buy_quote_volume": "Q"}
    return rows.select(
        F.col("m.s").alias("symbol"), F.col("m.k")["i"].alias("timeframe"), F.timestamp_millis(field("t", "long")).alias("open_time"), F.timestamp_millis(field("T", "long")).alias("close_time"),
        *[field(f, "double").alias(n) for n, f in number.items()], field("n", "long").alias("number_of_trades"), field("x", "boolean").alias("is_closed"),
    )


def window_slices(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    """slice_start, slice_end of a backfill: half-open windows of ``step`` that cover the span without overlap."""
    span = spark.sql(f"select explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - interval 1 microsecond, interval {step})) as slice_start")
    return span.select("slice_start", F.least(F.expr(f"slice_start + interval {step}"), F.expr(f"timestamp_ntz'{end}'")).alias("slice_end"))


def remaining_slices(bars: DataFrame, keys: Sequence[str], closes: str, until: str, step: str) -> DataFrame:
    """keys, slice_start, slice_end of what each series still lacks: from a millisecond after its last close to ``until``, in
    windows of ``step``; a series that has all of it has no row."""
    last = bars.groupBy(*keys).agg(F.max(closes).alias("_last")).where(F.col("_last").isNotNull())
    start, end = F.expr("_last + interval 1 millisecond"), F.lit(until).cast("timestamp_ntz")
    # the sequence excludes the end itself
    slices = last.where(start < end).withColumn("slice_start", F.explode(F.sequence(start.cast("timestamp_ntz"), F.expr(f"timestamp_ntz'{until}' - interval 1 microsecond"), F.expr(f"interval {step}"))))
    return slices.select(*keys, "slice_start", F.least(F.expr(f"slice_start + interval {step}"), end).alias("slice_end"))
