"""Ordered, idempotent event analytics on Spark DataFrames and streams."""
