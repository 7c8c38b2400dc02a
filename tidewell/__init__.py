"""Spark-native engine for append-only time series."""
