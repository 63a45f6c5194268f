"""Spark-native best-frame selection: streaming."""
