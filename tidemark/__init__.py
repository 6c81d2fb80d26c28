"""Tidemark: event observation analytics on Spark DataFrames."""
