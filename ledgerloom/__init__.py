"""Spark-native analytics for federated fraud detection and corpus preparation."""
