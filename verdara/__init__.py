"""Spark-native vegetation-index time-series engine."""

__version__ = "0.1.0"
