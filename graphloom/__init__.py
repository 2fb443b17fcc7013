"""Spark-native typed-graph analytics."""
