"""Tidemark: evidence and market-signal analytics as Spark DataFrame plans."""
