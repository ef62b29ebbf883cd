"""Temporal fact-graph analytics on PySpark."""
