"""Spark-native processing of logs, metrics and traces."""
