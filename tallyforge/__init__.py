"""Spark-native analytics for short hierarchical panels."""
