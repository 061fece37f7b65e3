"""Spark-native evaluation analytics."""
