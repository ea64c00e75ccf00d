"""Retrieval, ranking evaluation and corpus tooling as Spark DataFrame operators."""

__version__ = "0.1.0"
