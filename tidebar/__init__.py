"""Spark-native engine for ordered OHLCV bar series and event studies."""
