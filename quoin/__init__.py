"""Spark-native array analytics."""
