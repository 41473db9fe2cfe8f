"""Spark-native selection, retrieval and evaluation analytics."""
