"""Spark-native retrieval, dependency and corpus-processing engine."""
