"""Spark-native analytics for versioned, multilingual legal corpora."""

__version__ = "0.1.0"
