"""Spark-native analytics for multi-channel measurements."""
