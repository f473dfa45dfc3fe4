"""Spark-native analytics for live music: metrics, concerts, venues, revenue."""
