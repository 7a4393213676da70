"""Spark-native hybrid retrieval, ranking and corpus-preparation engine."""

__version__ = "0.1.0"
