"""Spark-native analytics over curated announcement corpora."""
