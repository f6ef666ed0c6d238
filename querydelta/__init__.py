"""Explain, on real Spark tables, what changes when a query changes."""

__version__ = "0.1.0"
