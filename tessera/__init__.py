"""Tessera: a Spark-native engine for iterative and numeric analytics on DataFrames."""

__version__ = "0.1.0"
