"""Spark-native dataset curation."""
