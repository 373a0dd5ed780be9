"""Retrieval and memory analytics over text, expressed as Spark DataFrames."""
