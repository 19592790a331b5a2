"""Retrieval and vector analytics over ordinary Spark DataFrames."""

__version__ = "0.1.0"
