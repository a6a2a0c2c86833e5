"""Spark-native catalogue analytics: listings, duplicates, clustering, metrics."""
