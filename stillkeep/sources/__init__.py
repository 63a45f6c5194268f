"""Spark-native best-frame selection: sources."""
