"""Spark-native corpus engineering: cleaning, licensing, deduplication, splitting, packing."""

__version__ = "0.1.0"
