"""Spark-native analytics for evaluating retrieval-augmented generation."""
