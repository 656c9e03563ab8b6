"""Governed metric analytics on Spark."""
