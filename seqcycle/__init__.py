"""Spark-first analytics over collections of short symbol sequences."""

__version__ = "0.1.0"
