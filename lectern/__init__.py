"""Spark-native analytics for large, dated collections of text."""
