"""Spark-native analytics over daily price panels of thinly traded assets."""

__version__ = "0.1.0"
