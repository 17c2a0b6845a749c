"""Spark-native analytics for ordered, position-indexed data."""
