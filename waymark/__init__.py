"""Waymark: place-retrieval analytics on Spark DataFrames."""
