"""Spark-native analytics over hierarchical image annotations and agent traces."""
