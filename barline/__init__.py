"""Ordered market-data analytics as plain PySpark DataFrame jobs."""
