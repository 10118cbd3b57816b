"""Retrieval tables on Spark: chunk, identify, diff, store, search and answer, as DataFrames."""

__version__ = "0.1.0"
