"""Spark-native retrieval, evaluation and table-history engine."""
