"""Spark-native engine for text and conversation datasets."""

__version__ = "0.1.0"
