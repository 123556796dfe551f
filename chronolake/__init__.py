"""Spark-native timeline analytics and training-data engine."""
