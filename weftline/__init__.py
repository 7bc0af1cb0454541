"""Spark-native analytics over media jobs, event logs, listings and caption text."""
