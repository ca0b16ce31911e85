"""Spark-first building blocks."""
