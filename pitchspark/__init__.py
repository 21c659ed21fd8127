"""Spark-native analytics over point-in-time event and quote data."""
