"""Spark-native analytics over catalogues of media-like items."""
