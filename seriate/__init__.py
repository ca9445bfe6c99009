"""Ordered sequences and key/value pairs on Spark DataFrames."""
