"""Spark-native synthetic-table engine: prepare, generate, score."""
