"""Spark-native analytics for execution-trace differencing and message-field analysis."""
