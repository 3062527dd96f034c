"""Spark-first engine for graph-augmented retrieval analytics and corpus preparation."""

__version__ = "0.1.0"
