"""Spark-native best-frame selection: operators."""
