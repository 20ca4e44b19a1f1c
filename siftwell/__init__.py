"""Hybrid document retrieval and document data processing on PySpark."""

__version__ = "0.1.0"
