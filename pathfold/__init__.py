"""Codebase-orientation analytics on Spark: plain tables in, DataFrames out."""

__version__ = "0.1.0"
