"""Spark-native engine for genomic interval data."""

__version__ = "0.1.0"
