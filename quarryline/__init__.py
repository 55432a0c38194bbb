"""Quarryline: relational code intelligence and hybrid retrieval on Spark."""

__version__ = "0.1.0"
