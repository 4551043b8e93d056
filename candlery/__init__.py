"""candlery: Spark-native operators for candles, logs and news feeds."""

__version__ = "0.1.0"
