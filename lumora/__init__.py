"""Spark-native analytics for a short-video localisation catalogue."""
