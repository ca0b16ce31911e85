"""Strandspark: document retrieval analytics and corpus preparation on PySpark."""
