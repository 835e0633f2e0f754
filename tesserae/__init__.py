"""Spark-native analytics over collections of Markdown notes."""

__version__ = "0.1.0"
