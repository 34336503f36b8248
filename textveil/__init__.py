"""Spark-native engine for finding, replacing and evaluating visible text in documents and images."""

__version__ = "0.1.0"
