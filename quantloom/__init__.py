"""Spark-native analytics for long tables of quantitative measurements."""
