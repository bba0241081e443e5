"""Spark-first analytics engine for creator-and-content datasets."""
