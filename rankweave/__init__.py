"""Spark-native analytics for directory, listing and review data."""
