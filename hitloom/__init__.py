"""Spark-native analytics for segmented-detector hit records."""

__version__ = "0.1.0"
