"""Spark-first engine for the quality and identity of place records."""
