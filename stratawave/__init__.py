"""Spark-native analytics for time-stamped sensor and array data."""

__version__ = "0.1.0"
