"""Spark-native curation and evaluation engine for post-training data."""
