"""Spark-native best-frame selection: plans."""
