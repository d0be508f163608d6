"""Leakage-safe evaluation analytics on PySpark."""
