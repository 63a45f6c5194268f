"""Spark-native best-frame selection: functions."""
