"""Spark-native analytics for evidence-backed knowledge graphs."""
